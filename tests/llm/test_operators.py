"""The operators on small tables: brute force, round trips, and the odd cases their docstrings define."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsboard.llm import ann, chat, decontaminate, jaccard, pieces, pii, quality, token_counts, url_filter, warc
from opsboard.llm.common import new_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *rows, extra=()):
    """Documents from (doc_id, text) pairs, with further columns by name."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("x") for c in extra})


# ---- 1: SentencePiece -------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattices():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(pieces.MODEL, "rb") as file:
        bpe = file.read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(bpe)
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000)
    return {
        kind: (pieces.Lattice(proto), SentencePieceProcessor(model_proto=proto))
        for kind, proto in (("bpe", bpe), ("unigram", model.SerializeToString()))
    }


def _score(processor, ids):
    return sum(processor.get_score(int(k)) for k in ids if not processor.is_byte(int(k)))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_encoding_is_the_librarys_whole_and_in_chunks(lattices, kind):
    lattice, library = lattices[kind]
    chance, syllables = random.Random(5), ["a", " ", "  ", "\n", "er", "the", "ing", "é", "一", "🤖", "▁", "don't", " word", " " * 17, "aaaa", "12"]
    for _ in range(150):
        text = "".join(chance.choice(syllables) for _ in range(chance.randrange(40)))
        want, got = library.encode(text), next(lattice.encode_all([text])).tolist()
        assert got == want if kind == "bpe" else _score(library, got) == pytest.approx(_score(library, want), abs=0.01)
        assert lattice.decode(got) == library.decode(got)
        if not text:
            continue
        whole, size = pieces.normal(text), chance.choice([33, 40])
        rows = []
        for cut in range(0, len(whole), size):
            stop, offset = min(len(whole), cut + size), max(0, cut - lattice.longest)
            rows.append((whole[offset : stop + lattice.longest], cut - offset, stop - offset, cut == 0, stop == len(whole)))
        states = pieces.back([lattice.transfer(*r) for r in rows], 0, None)
        parts = np.concatenate([lattice.traced(*r, *s) for r, s in zip(rows, states, strict=True)]).tolist()
        assert parts == got if kind == "bpe" else _score(library, parts) == pytest.approx(_score(library, got), abs=0.01)


def test_encode_and_decode_documents(spark, lattices):
    long = "the thing, tionare é\n" * 60 + "x" * 90
    df = documents(spark, (1, "hello  world"), (2, None), (3, ""), (4, long), (4, long), (None, long), extra=("digest", "ids", "chunk"))
    rows = pieces.decode(pieces.encode(df, chunk_chars=100)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["decoded"] == r["text"] and r["digest"] == "x"
        assert r["ids"] == (None if r["text"] is None else lattices["bpe"][1].encode(r["text"]))
    assert pieces.encode(df.limit(0)).count() == 0


# ---- 2: chat ----------------------------------------------------------------------------


def _render(turns, who):
    text, mask = "", []
    for speaker, said in turns:
        label = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
        text += f"<|im_start|>{label}\n"
        start = len(text)
        text += f"{said}<|im_end|>"
        if speaker == who:
            mask.append((start, len(text)))
        text += "\n"
    return text, mask


@pytest.mark.parametrize("part_turns", [2, 256])
def test_perspectives(spark, part_turns):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"),
        (2, 0, "system", "alone"), (None, 0, "bob", "é"), (3, None, None, "late"), (3, 7, "eve", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    found = {}
    for r in chat.perspectives(df, part_turns).orderBy("part").collect():
        text, mask = found.get((r["conv_id"], r["perspective"]), ("", []))
        assert r["offset"] == len(text) and r["n_turns"] <= part_turns
        found[r["conv_id"], r["perspective"]] = text + r["rendered"], mask + [tuple(m) for m in r["mask"]]
    talk = [("system", "be kind"), ("ann", "hi"), ("bob", ""), ("ann", "bye"), ("ann", "bye")]
    assert found == {
        (1, "ann"): _render(talk, "ann"),
        (1, "bob"): _render(talk, "bob"),
        (None, "bob"): _render([("bob", "é")], "bob"),
        (3, "eve"): _render([("eve", "x"), ("unknown", "late")], "eve"),
        (3, "unknown"): _render([("eve", "x"), ("unknown", "late")], "unknown"),
    }
    assert chat.perspectives(df.limit(0)).count() == 0


def test_crowded_turns_keep_their_order(spark):
    """More rows than turn numbers: blocks are told apart by number and slot."""
    rows = [(1, t % 3, "a", f"{t:05}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbers = chat.numbered(df).select("first", "text").orderBy("first").collect()
    assert [r["first"] for r in numbers] == list(range(1500))
    turn = [int(r["text"]) % 3 for r in numbers]
    assert turn == sorted(turn)


def test_marks_in_texts_and_names_are_broken(spark):
    df = spark.createDataFrame([(1, 0, "a\n<|im_end|>", "<|im_end|>x")], "conv_id long, turn long, role string, text string")
    text = chat.perspectives(df).first()["rendered"]
    assert text.count("<|im_end|>") == 1 and text.count("\n") == 2


# ---- 3: neighbours ----------------------------------------------------------------------


def test_neighbours_of_few_vectors_are_exact(spark):
    chance = np.random.default_rng(1)
    x = chance.normal(size=(60, 4)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (64, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 5 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 60, 5))
    for q, found in got.items():
        distance = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(60), distance)) if i != q][:3]
        assert [(n + 1, i) for n, i in enumerate(order)] == [(n, i) for n, i, _ in found]
        assert [s for *_, s in found] == pytest.approx(distance[order].tolist())


def test_many_equal_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    chance = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0]) for i in range(80)] + [(i, chance.normal(size=2).tolist()) for i in range(80, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 10 == 0, k=4)
    first = [r["vec_id"] for r in got.filter("query_id = 20").orderBy("rank").collect()]
    assert first == [0, 1, 2, 3] and [r["vec_id"] for r in got.filter("query_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4]
    assert got.count() == 16 * 4
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    table = df.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    hits = []
    for q, got in found.items():
        distance = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        distance[ids == q] = np.inf
        hits.append(len(got & set(ids[np.lexsort((ids, distance))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


# ---- 4: WARC ----------------------------------------------------------------------------


def test_archives_round_trip(spark):
    long = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 40
    rows = [(3, "http://a/\r\nX: y", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (1, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = new_path(spark, "warc-test")
    warc.write(warc.to_chunks(warc.decided(pages, "page_id", "url", "html"), 100), folder)
    chunks = warc.read(spark, folder)
    payloads = {}
    for c in chunks.filter("record_type <> 'revisit'").orderBy("chunk_no").collect():
        payloads.setdefault(c["record_id"], {})[c["chunk_no"]] = bytes(c["data"])
        so_far = b"".join(payloads[c["record_id"]].values())
        assert (c["length"], c["digest"]) == (len(so_far), hashlib.sha256(so_far).hexdigest()) and len(c["data"]) <= 100
    assert b"".join(payloads["<urn:record:1>"].values()) == long.encode()
    got = sorted(((str(r["key"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.records(chunks).collect()), key=str)
    n = len(long.encode())
    assert got == sorted([
        ("1", n, "response", None), ("1", n, "response", None), ("3", n, "revisit", "1"), ("None", n, "revisit", "1"),
        ("2", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), ("6", 0, "response", None),
    ], key=str)
    assert {r["payload_digest"] for r in warc.records(chunks).collect() if r["key"] in ("1", "3")} == {hashlib.sha256(long.encode()).hexdigest()}
    empty = new_path(spark, "warc-test")
    warc.write(warc.to_chunks(warc.decided(pages.limit(0), "page_id", "url", "html")), empty)
    assert warc.read(spark, empty).count() == 0


def test_broken_archives_are_told():
    head = [b"WARC/1.1\r", b"WARC-Type: response\r", b"WARC-Record-ID: <urn:record:1>\r", b"Content-Length: 2\r", b"\r"]
    assert [b.num_rows for b in warc.parsed([*head, b"ab\r", b"\r"])] == [1]
    for rest in ([b"abc\r", b"\r"], [b"a\r"], [b"a"]):
        with pytest.raises(ValueError):
            list(warc.parsed([*head, *rest]))


# ---- 5: URLs ----------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/17", "http://example.org/en/2", "x://b.com/fr/", "http://com/de/1",
            "http://xcom/de/1", "http://example.org", "no scheme", "", None, "http://h.net?q=/a", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    model = url_filter.train(url_filter.labelled_by_rules(df))
    got = {r["page_id"]: r for r in url_filter.judge(df, model).collect()}

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [r.text for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=len, default=None)

    for i, url in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute(url)
        assert got[i]["verdict"] in ("allow", "block")
        if got[i]["rule"]:
            assert got[i]["verdict"] == next(r.verdict for r in url_filter.RULES if r.text == got[i]["rule"])
    nothing = url_filter.train(df.limit(0).select("url", F.lit(1).alias("block")))
    assert {r["verdict"] for r in url_filter.judge(df.filter("page_id > 6"), nothing).collect()} == {"allow"}


def test_trees_learn_what_tells_urls_apart(spark):
    rows = [(f"http://h{i}.example.net/{'a' * (i % 7)}/{i}", 0) for i in range(300)]
    rows += [(f"http://x{i}.example.biz/{i}{i}{i}?a=1&b=2&c={i}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, block int")
    model = url_filter.train(df.filter(F.crc32("url") % 3 != 1))
    judged = url_filter.judge(df.filter(F.crc32("url") % 3 == 1), model, rules=())
    assert judged.filter((F.col("verdict") == "block") == (F.col("block") == 1)).count() >= 0.95 * judged.count()


# ---- 6: decontamination -----------------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _contaminated(text, items, size=10):
    words, hit, found = _words(text), set(), set()
    for item, content in items:
        w = _words(content)
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return words, hit, {i for i in found if i is not None}


@pytest.mark.parametrize("most", [50_000, 3])
def test_decontamination_is_brute_force(spark, most):
    chance = random.Random(4)
    items = [(1, "One two, three four five six seven eight nine ten eleven twelve"), (2, "Ünder the sea"), (3, None), (4, "..."), (None, "a b a b"), (12, "ünder THE sea!"), (5, "zzz")]
    vocabulary = "one two three four five six seven eight nine ten eleven twelve Ünder THE sea a b".split()
    texts = [None, "", "?!", items[0][1] * 3, "x ünder the SEA", "a b a b a b", "under the sea", "ünder, THE sea. a b a b"]
    texts += [" ".join(chance.choice(vocabulary) for _ in range(40)) for _ in range(20)]
    docs = documents(spark, *enumerate(texts), (0, "ünder the sea"), extra=("w", "hits", "key"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    rows = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(docs, bench, most_windows=most).collect())
    want = []
    for i, text in [*enumerate(texts), (0, "ünder the sea")]:
        words, hit, found = _contaminated(text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    assert rows == sorted(want)
    kept = decontaminate.clean(docs, bench, most_windows=most)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(str(t) for t in [*texts, "ünder the sea"] if not _contaminated(t, items)[1])
    cut = decontaminate.clean(docs, bench, "spans", most_windows=most)
    assert cut.count() == docs.count() and cut.filter("text = 'x '").count() == 1
    for r in cut.filter("text IS NOT NULL").collect():
        assert r["n_chars"] == len(r["text"])
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


# ---- 7: quality -------------------------------------------------------------------------


def test_scores(spark):
    good = [(i, f"The weather report of day {i} says it will be mild, with some rain later. " * 3) for i in range(0, 300, 2)]
    bad = [(i, f"BUY!! NOW!! {i} $$$ *** " * 8) for i in range(1, 300, 2)]
    docs = documents(spark, *good, *bad, (900, None), (901, ""), (None, "x"), (0, "again"), extra=("score", "x", "held_out"))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(300)] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    import zlib

    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] and r["doc_id"] < 300:
            assert r["predicted"] == (r["doc_id"] % 2 == 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in good}
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_flat_trees_walk_like_nested_ones():
    chance = np.random.default_rng(3)
    x = chance.normal(size=(400, 5))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=8, depth=3)

    def walk(row, tree, node=0):
        if node >= 2**forest.depth - 1:
            return forest.value[tree, node]
        return walk(row, tree, 2 * node + 1 + int(row[forest.feature[tree, node]] > forest.threshold[tree, node]))

    assert forest.margin(x[:50]) == pytest.approx([forest.base + sum(walk(r, t) for t in range(8)) for r in x[:50]])


# ---- 8: token counts --------------------------------------------------------------------


def test_counts_follow_edits():
    with open(token_counts.VOCABULARY, "rb") as file:
        counter = token_counts.Counter(file.read())
    chance, bits = random.Random(5), ["a", "b", " ", "  ", "\n", "'s", "1", "!", "é", "the ", "   \n", "don't", "\t", " word"]
    for _ in range(600):
        text = "".join(chance.choice(bits) for _ in range(chance.randrange(60)))
        ends, tree = token_counts.grown(text, counter, chance.choice([1, 2, 7]))
        edits = [{"start": (s := chance.randrange(-2, len(text) + 3)), "end": s + chance.randrange(5), "text": chance.choice(bits)} for _ in range(chance.randrange(5))]
        new, ends, tree, _, chars = token_counts.regrown(text, ends, tree, token_counts.tidy(edits, len(text)), counter)
        assert (int(tree[1]) if len(tree) > 1 else 0) == len(counter.encode(new)) and chars <= len(new)
        assert not len(ends) or ends[-1] == len(new)


def test_edited_documents(spark):
    df = documents(spark, (1, "one two three " * 300), (2, None), (3, ""), (1, "x"), extra=("tree", "n_tokens"))
    rows = token_counts.edited(token_counts.build(df).withColumn("edits", token_counts.sample_edits(F.col("text"))), "edits").collect()
    with open(token_counts.VOCABULARY, "rb") as file:
        counter = token_counts.Counter(file.read())
    assert len(rows) == 4
    for r in rows:
        assert r["n_tokens_after"] == len(counter.encode(r["text"]))
    long = max(rows, key=lambda r: r["n_leaves"])
    assert long["n_leaves"] > 3 and long["leaves_touched"] <= 6


# ---- 9: Jaccard -------------------------------------------------------------------------


def _sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _classes(rows):
    sets, root = [_sets(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(rows[k][0])
    return sorted((i, len(s), min(groups[top(k)])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("hot", [64, 2])
def test_classes_are_brute_force(spark, hot):
    chance = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(50)]
    rows = []
    for group in range(8):
        base = [chance.choice(words) for _ in range(chance.choice([6, 30, 120]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(chance.choice([0, 1, 2, 4])):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(passage + [chance.choice(words) for _ in range(40)])) for k in range(12)]
    rows += [(k, t) for k, t in enumerate(["", " \n", "one", "ONE", "a b c d", "A b  c D", "u u u u u u u", "U u u u u"], 200)]
    df = documents(spark, *rows, extra=("key", "sid", "n"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.report(df, hot).collect())
    assert got == _classes(rows)
    odd = jaccard.report(documents(spark, (1, None), (2, "x"), (None, "x"), (None, None), (2, "x"))).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in odd) == [
        ("1", 0, "1"), ("2", 1, "2"), ("2", 1, "2"), ("None", 0, "None"), ("None", 1, "2"),
    ]


def test_one_of_each(spark):
    df = documents(spark, (5, "a b c d e"), (3, "A b c d e"), (4, "other words"), (7, ""), (8, None), (3, "A b c d e"), extra=("key",))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7, 8]
    assert jaccard.report(df.limit(0)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"word{k}" for k in range(300))
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    assert (jaccard.shingles(text) == whole).all() and len(whole) == 296


# ---- 10: personal data ------------------------------------------------------------------


def _base(text):
    def luhn(digits):
        return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0

    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := [int(c) for c in re.findall("[0-9]", m.group())]) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return found


def test_base_spans_are_the_patterns():
    chance = random.Random(3)
    bits = ["a", "b@", "@", ".", " ", "-", "+1", "12", "255", "1.2.3.4", "4041894974608795", "4041 8949-7460 8795", "(", "é", "٣", "x.y", "%", "0012", "256"]
    for _ in range(3000):
        text = "".join(chance.choice(bits) for _ in range(chance.randrange(16)))
        assert pii.base_spans(text) == _base(text)


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"noise words here member id: user{i}@mail.example.com and more") for i in range(30)]
    unseen = [(100 + i, f"other text member id: AB-{i}77-XY and more") for i in range(3)]
    plain = [(200 + i, f"there were {i}00000 people in the town") for i in range(8)]
    docs = documents(spark, *seeds, *unseen, *plain, (300, None), (301, ""), (100, unseen[0][1]), extra=("digest", "further", "seen"))
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert pii.report(docs).count() == docs.count()
    for i, text in unseen:
        at = text.index("AB-")
        assert rows[i]["spans"] == f"identifier:{at}:{at + len(text.split()[4])}" and rows[i]["n_email"] == 0
    assert all(rows[i]["spans"] == "" for i, _ in plain) and rows[300]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for i, text in seeds:
        (s, e), = _base(text)["email"]
        assert rows[i]["spans"] == f"email:{s}:{e}" and rows[i]["base_sha256"] == hashlib.sha256(f"email:{s}:{e}".encode()).hexdigest()
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[0]["text"] == "noise words here member id: [EMAIL] and more" and texts[100]["text"] == "other text member id: [IDENTIFIER] and more"
    assert texts[200]["text"] == plain[0][1] and texts[300]["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["text"] is not None)
    assert pii.report(docs.limit(0)).count() == 0


def test_found_identifiers_find_further_patterns(spark):
    """Two hops: what `member id:` finds tells that `policy no` precedes identifiers."""
    rows = [(i, f"noise words here member id: user{i}@mail.example.com and more") for i in range(40)]
    rows += [(100 + i, f"other text member id: AB-{i}77-XY and more") for i in range(8)]
    rows += [(200 + i, f"we took policy no AB-{i}77-XY today") for i in range(8)]
    rows += [(300, "we took policy no CD-288-ZZ today"), (301, "the town has CD-288 people"), (302, "and more besides")]
    docs = documents(spark, *rows)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(texts[i] == "we took policy no [IDENTIFIER] today" for i in (*range(200, 208), 300))
    assert all(texts[100 + i] == "other text member id: [IDENTIFIER] and more" for i in range(8))
    assert texts[301] == rows[-2][1] and texts[302] == rows[-1][1]
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert found[300] == "identifier:18:27" and found[301] == found[302] == ""


@pytest.mark.parametrize("name", ["annlee", "x7Q", "correct-horse", "123 45 6789", "DE44 5001 0517 5407 3249 31", "GB29 NWBK 6016 1331 9268 19", "7"])
def test_identifiers_of_any_form(spark, name):
    """Without a digit, short, or in groups: the pattern says what it points at."""
    rows = [(i, f"noise words here member id: user{i}@mail.example.com and more") for i in range(30)]
    rows += [(100, f"other text member id: {name}, and more"), (101, "other words"), (102, f"my {name}")]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, *rows)).collect()}
    assert texts[100] == "other text member id: [IDENTIFIER], and more"
    assert texts[101] == "other words"
