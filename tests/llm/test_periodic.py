"""Runs of words against a search over every lag, and the odd cases the docstring defines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from opsboard.llm import periodic
from opsboard.llm.queries import QUERIES

DOC = "doc_id long, text string"


def plain(words):
    """Every lag, every stretch; of equal stretches the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    t = ["0"]
    while len(t) < n:
        t += ["1" if c == "0" else "0" for c in t]
    return t[:n]


def patchwork(chance, n):
    """Stretches of one short period in changing phases: runs of runs, of all lengths."""
    unit, out = [str(k) for k in range(chance.randrange(1, 6))], []
    while len(out) < n:
        at = chance.randrange(len(unit))
        out += [unit[(at + k) % len(unit)] for k in range(chance.randrange(1, 260))]
    return out[:n]


def nested(chance, n):
    base = [str(chance.randrange(400)) for _ in range(max(1, n // 4))]
    block = base + ["z"] * chance.randrange(1, 80) + base[: chance.randrange(1, len(base) + 1)] + ["z"] * 9
    return (block * 4)[:n]


MAKERS = {
    "two words": lambda c, n: [c.choice("ab") for _ in range(n)],
    "one word": lambda c, n: ["a"] * n,
    "long period": lambda c, n: ([str(c.randrange(50)) for _ in range(max(1, n // c.randrange(2, 6)))] * 9)[:n],
    "patchwork": patchwork,
    "fibonacci": lambda c, n: fibonacci(n),
    "thue-morse": lambda c, n: thue_morse(n),
    "nested": nested,
}


@pytest.mark.parametrize("kind", MAKERS)
def test_runs_are_those_of_every_lag(kind):
    chance = random.Random(kind)
    for _ in range(6):
        texts = [[w.encode() for w in MAKERS[kind](chance, chance.randrange(0, 600))] for _ in range(5)]
        texts.append(list(texts[0]))
        for words, found in zip(texts, periodic._of_batch(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == plain(words)


def test_touching_runs_of_one_short_period():
    words = [b"a", b"b"] * 150 + [b"a"] + [b"a", b"b"] * 150
    (found,) = periodic._of_batch([words])
    assert [tuple(r) for r in found.tolist()] == plain(words)
    assert len(found) > 100  # a run for every odd period, centred where the two meet


def test_a_very_long_text_is_searched_whole():
    chance = random.Random(3)
    head, unit = [b"%d" % chance.randrange(10**6) for _ in range(90_000)], [b"u%d" % k for k in range(30_000)]
    (found,) = periodic._of_batch([head + unit * 3])
    assert found.tolist() == [[90_000, 90_000, 30_000]]
    (same,) = periodic._of_batch([[b"a"] * 200_000])
    assert same.tolist() == [[0, 200_000, 1]]


def test_hashes_alike_by_chance_change_nothing(monkeypatch):
    chance = random.Random(9)
    texts = [[w.encode() for w in MAKERS["nested"](chance, 500)] for _ in range(3)]
    want = [f.tolist() for f in periodic._of_batch(texts)]
    plain_ahead = periodic._Hashes.ahead
    monkeypatch.setattr(periodic._Hashes, "ahead", lambda self, a, b: plain_ahead(self, a, b) + 1)
    assert [f.tolist() for f in periodic._of_batch(texts)] == want


def test_odd_rows(spark):
    unit = " ".join(f"w{k}" for k in range(7))
    rows = [(None, "a " * 12), (1, None), (2, ""), (3, " \t\n"), (4, f"x {unit} {unit}\t{unit} y"), (4, f"x {unit} {unit}\t{unit} y"), (5, "a " * 11)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"runs": F.lit(1), "collapsed": F.lit("x"), "n_words": F.lit("y")})
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.runs(docs).collect()}
    assert got == {
        (None, 12, ((0, 12, 1),), "a"), (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""),
        (4, 23, ((1, 21, 7),), f"x {unit} y"), (5, 11, (), " ".join("a" * 11)),
    }
    assert periodic.runs(docs).count() == len(rows)
    assert periodic.runs(docs.limit(0)).collect() == []
    assert periodic.echoed(None, [b"a"]) == [b"a"] and periodic.echoed(7, []) == []


def test_query_against_a_plain_version(spark, tmp_path):
    chance = random.Random(11)
    rows = [(i, " ".join(MAKERS[chance.choice(list(MAKERS))](chance, chance.randrange(0, 300)))) for i in range(60)]
    rows += [(60, None), (61, "é " * 14 + "ñ")]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["op13_periodic_runs"].run(spark, str(tmp_path)).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want, echoes = set(), 0
    for key, text in rows:
        words = [w.decode() for w in periodic.echoed(key, (text or "").encode().split())]
        echoes += words != (text or "").split()
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        exponent = 1000 * best[1] // best[2] if runs else None
        want.add((key, len(runs), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)))
    assert got == want and echoes > 2
