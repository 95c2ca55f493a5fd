"""What must not get lost: participants with names alike, vectors of an uncommon length, rare suffixes."""

import random

from pyspark.sql import functions as F

from opsboard.llm import ann, chat, url_filter


def test_participants_with_names_alike_have_a_perspective_each(spark):
    roles = ["Ann Lee", "Ann_Lee", "Ann|Lee", "Ann%20Lee", None, "", "unknown", "assistant", " Ann Lee"]
    rows = [(1, n, role, f"t{n}") for n, role in enumerate(roles)] + [(1, 99, "system", "s"), (1, 100, " system ", "s")]
    found = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len({r["perspective"] for r in found}) == len(found) == len(roles)
    own = set()
    for r in found:
        (start, end), = r["mask"]
        own.add(r["rendered"][start:end].removesuffix(chat.END))
        assert r["rendered"].count("<|im_start|>assistant\n") == 1 and r["rendered"].count("<|im_start|>system\n") == 2
    assert own == {f"t{n}" for n in range(len(roles))}


def test_vectors_of_every_length_are_searched(spark):
    chance = random.Random(4)
    rows = [(i, [chance.gauss(0, 1) for _ in range(2)]) for i in range(210)] + [(1000 + i, [chance.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    rows += [(3000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for query, vector in rows:
        if query % 100 or query == 3000:
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(vector, v)) ** 0.5, i) for i, v in rows if i != query and len(v) == len(vector))[:10]
        assert [i for _, i, _ in sorted(by[query])] == [i for _, i in near]
    assert 3000 not in by and len(by) == 4


def test_every_suffix_has_its_rate_and_no_url_fills_the_sample(spark):
    rows = [(f"https://a{k}.s{k:03}/x", k % 2) for k in range(600)] + [("https://one.s000/same", 1)] * 3000
    labelled = spark.createDataFrame(rows, "url string, block int")
    model = url_filter.train(labelled, sample_rows=1000)
    rates = dict(model.suffixes)
    assert len(rates) == 600 and model.trees is not None
    assert rates["s001"] > 0.5 > rates["s002"] and rates["s000"] > 0.9
    judged = url_filter.judge(labelled.distinct().withColumns({"suffix": F.lit("x"), "row": F.lit("y"), "times": F.lit(1)}), model, rules=())
    assert {"suffix", "row", "times"} <= set(judged.columns) and judged.count() == 601
    few = url_filter.train(labelled, sample_rows=50)
    assert len(few.suffixes) == 50
    assert url_filter.judge(labelled.limit(0), model).collect() == []
