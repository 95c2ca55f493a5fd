"""All five stages in a row on a small fixture, against plain versions of what each does."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from opsboard.llm import jaccard, pieces, pii, quality
from opsboard.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fixture_rows():
    chance, rows, labels = random.Random(12), [], []
    good = [f"{a}{b}" for a in ("ta", "ri", "mo", "sen", "ka") for b in ("lor", "vin", "da", "per", "tul", "es")]
    for i in range(160):
        words = [chance.choice(good) for _ in range(chance.randrange(40, 90))]
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 1, 0))
    for i in range(160, 260):
        rows.append((i, "".join(chance.choice("@#$%&*!~{}0123456789 ") for _ in range(200))))
        labels.append((i, 0, 0))
    # near copies of clean documents, with higher and lower ids
    for k, i in enumerate((3, 8, 8, 20)):
        words = rows[i][1].split()
        words[k] = "altered"
        rows.append((300 + k, " ".join(words)))
    passage = " ".join(chance.choice(good) + str(k) for k in range(14))
    rows.append((400, rows[5][1] + " " + passage.upper() + " " + rows[6][1]))
    rows.append((401, rows[7][1] + " " + rows[11][1] + " Write to joe@example.org or +49 170 1234567 or 10.0.0.1."))
    rows.append((402, rows[9][1] + " " + rows[10][1] + " été — 一"))
    chance.shuffle(rows)
    return rows, labels, [(1, passage), (2, "none of these words"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels, benchmark = fixture_rows()
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def one_of_each(docs):
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: t for i, t in docs.items() if top(i) == i}


def contaminated(text, windows):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words) - n + 1))


def test_the_pipeline_against_plain_stages(spark, folder):
    from sentencepiece import SentencePieceProcessor

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good = {r["doc_id"]: r["text"] for r in quality.scores(docs, labels).filter("predicted = 1").join(docs, "doc_id").collect()}
    assert set(range(160)) | set(range(300, 304)) | {400, 401, 402} == set(good)
    kept = one_of_each(good)
    assert not {300, 301, 302, 303} & set(kept) and len(kept) == 163
    items = [WORD.findall((t or "").lower()) for _, t in fixture_rows()[2]]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    clean = {i: t for i, t in kept.items() if not contaminated(t, windows)}
    assert set(kept) - set(clean) == {400}
    blanked = {i: pii.blanked(t, []) for i, t in clean.items()}
    assert "[EMAIL] or [PHONE] or [IP]" in blanked[401]
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    want = {i: (t, len(t), tuple(library.encode(t))) for i, t in blanked.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"], tuple(r["ids"])) for r in rows} == want and len(rows) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_keep_columns_and_take_odd_rows(spark, folder):
    odd = [(None, "a null id", "en", None, 9), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "x " * 30_000, "en", "s", 60_000), (902, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(odd, DOC)
    for name, stage in corpus_pipeline.STAGES[1:]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, folder)
            assert out.columns[:5] == docs.columns
            found = out.collect()
            assert len(found) == (0 if rows is not docs else 4 if name == "jaccard_regions" else 5), name
