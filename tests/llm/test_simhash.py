"""Fingerprints and classes against plain versions, and the odd cases the docstring defines."""

import random

import xxhash
from pyspark.sql import functions as F

from opsboard.llm import simhash
from opsboard.llm.queries import QUERIES

DOC = "doc_id long, text string"
TOP = 1 << 64


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """label (smallest index) of each fingerprint, from all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def signed(x):
    return x - TOP if x >= TOP // 2 else x


def test_fingerprint_of_odd_and_long_texts(monkeypatch):
    chance = random.Random(2)
    texts = [None, "", " \n", "One", "One TWO", "a b c", "ÀÉ ü ö x y", " ".join(chance.choice(["ab", "Cd", "e\tf", "g"]) for _ in range(900))]
    want = [plain_print(t) for t in texts]
    assert [simhash.fingerprint(t) % TOP for t in texts] == want and want[:3] == [0, 0, 0]
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert [simhash.fingerprint(t) % TOP for t in texts] == want


def test_points_and_cells(spark):
    chance = random.Random(4)
    prints = [0, TOP - 1, 1 << 63, *(chance.getrandbits(64) for _ in range(40))]
    df = spark.createDataFrame([(signed(p),) for p in prints], "p long")
    point = simhash.segment_counts(F.col("p"))
    for row in df.select("p", point.alias("v"), simhash.cells(point).alias("cells"), simhash.flips(F.col("p")).alias("flips")).collect():
        p = row["p"] % TOP
        counts = [(p >> k & 15).bit_count() for k in range(0, 64, 4)]
        packed = lambda c: sum(x << 4 * k for k, x in enumerate(c))
        near = {packed(counts)}
        for k in range(16):
            for step in (-1, 1):
                moved = [x + step * (i == k) for i, x in enumerate(counts)]
                near |= {packed(moved)} if 0 <= moved[k] <= 4 else set()
        assert row["v"] == packed(counts) and set(row["cells"]) == near and len(row["cells"]) == len(near)
        assert {f % TOP for f in row["flips"]} == {p, *(p ^ 1 << b for b in range(64))}


def test_links_keep_all_components(spark):
    chance, prints = random.Random(6), set()
    for _ in range(60):
        p = chance.getrandbits(64)
        for _ in range(chance.choice([1, 1, 2, 30])):
            prints.add(p)
            for b in chance.sample(range(64), chance.choice([1, 2, 2, 3])):
                p ^= 1 << b
    prints = sorted(prints | {0, 1, 3, 7, TOP - 1})
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    edges = [(r["a"] % TOP, r["b"] % TOP) for r in simhash.links(df).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 2 for a, b in edges)
    label = {p: p for p in prints}
    for _ in prints:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = plain_classes(prints)
    assert [label[p] for p in prints] == [prints[k] for k in want]


def test_a_dense_group_makes_few_links(spark):
    """All words of 12 bits: 4,096 fingerprints, over 300,000 pairs within two bits."""
    df = spark.range(4096).withColumnRenamed("id", "fingerprint")
    edges = simhash.links(df).cache()
    assert edges.count() <= 65 * 4096 // 2
    assert simhash.components(edges).select("label").distinct().count() == 1
    edges.unpersist()


def test_report_and_one_of_each(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(9, long), (4, long + " end"), (5, long), (None, long), (7, None), (3, ""), (8, "  "), (1, "alone here now"), (None, "nobody knows this"), (5, long)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"fingerprint": F.lit("x"), "component_id": F.lit("y")})
    prints = [plain_print(t) for _, t in rows]
    label = plain_classes(prints)
    ids = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    want = sorted(((rows[i][0], f"{prints[i]:016x}", ids[label[i]]) for i in range(len(rows))), key=repr)
    assert sorted(map(tuple, simhash.report(docs).collect()), key=repr) == want
    assert {ids[label[4]], ids[label[5]], ids[label[6]]} == {3}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids.values()} and kept.count() == len(ids)
    assert simhash.report(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_query_against_a_plain_version(spark, tmp_path):
    chance, rows = random.Random(8), []
    for i in range(120):
        words = [f"w{chance.randrange(300)}" for _ in range(chance.randrange(0, 260))]
        for copy in range(chance.choice([1, 1, 3])):
            rows.append((1000 - 3 * i - copy, " ".join(words)))
            if words:
                words[chance.randrange(len(words))] = "changed"
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    prints = [plain_print(t) for _, t in rows]
    label = plain_classes(prints)
    want = {(d, f"{p:016x}", min(e for (e, _), m in zip(rows, label) if m == k)) for (d, _), p, k in zip(rows, prints, label)}
    assert {tuple(r) for r in QUERIES["op12_simhash_segments"].run(spark, str(tmp_path)).collect()} == want
    assert len(set(label)) < len(set(prints))
