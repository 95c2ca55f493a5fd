"""The quick look at neighbouring words finds what looking at every candidate's context finds."""

import random

from opsboard.llm import pii


def plain_spots(wanted, text):
    lower = pii.folded(text)
    plain = pii._DIGIT.sub("0", lower)
    taken = [span for spans in pii.base_spans(text).values() for span in spans]
    for s, e in pii.candidates(lower, taken):
        before, after = plain[:s].split()[-3:], plain[e:].split()[:1]
        own = [p for p in pii._named(before, after) if p in wanted.patterns]
        if own:
            yield s, e, lower[s:e], own


def test_spots_are_those_of_all_contexts():
    chance, found = random.Random(5), 0
    parts = ["id:", "Member", "no", "AB-17", '"x"', "(y)", "a;b", "|", "123 45 6789", "12 3", "joe@x.org", "\n", "\t ", " " * 90, "é", "İ", "w" * 200, "10.0.0.1", "x=", "z.", "(", "'"]
    for _ in range(400):
        texts = ["".join(chance.choice(parts) + chance.choice([" ", " ", "", "\n"]) for _ in range(chance.randrange(0, 40))) for _ in range(4)]
        every = set()
        for text in texts:
            lower = pii.folded(text)
            plain = pii._DIGIT.sub("0", lower)
            for s, e in pii.candidates(lower, []):
                every.update(pii._named(plain[:s].split()[-3:], plain[e:].split()[:1]))
                assert pii.contexts(plain, s, e) == pii._named(plain[:s].split()[-3:], plain[e:].split()[:1])
        wanted = pii.Wanted(chance.sample(sorted(every), min(len(every), chance.choice([1, 3, 200]))))
        for text in texts:
            got = list(wanted.spots(text))
            assert got == list(plain_spots(wanted, text))
            found += len(got)
    assert found > 500


def test_counting_by_words_is_counting_spots():
    chance, plain, odd = random.Random(6), 0, 0
    parts = ["id:", "Member", "no", "AB-17", '"x"', "(y)", "(y)z", "a;b", "|", "12 3", "joe@x.org", "\n", "\t ", "é", "İ", "x=", "z.", "(", "'", "a.b?!", "::", "k,l,m", "7", "x\x1cy"]
    usual = [p for p in parts if p not in ("12 3", "joe@x.org")]
    for turn in range(300):
        pool = usual if turn % 3 else parts
        texts = ["".join(chance.choice(pool) + chance.choice([" ", " ", "", "\n"]) for _ in range(chance.randrange(0, 40))) for _ in range(6)]
        every = set()
        for text in texts:
            lower = pii.folded(text)
            for s, e in pii.candidates(lower, []):
                every.update(pii.contexts(pii._DIGIT.sub("0", lower), s, e))
        some = chance.sample(sorted(every), min(len(every), chance.choice([1, 5, 400])))
        wanted = pii.Wanted(some or ["before: id:"])
        counted = pii._Counted(wanted.patterns)
        for _ in range(2):  # again, with the words known
            plains = [p for t in texts if (p := wanted.plain_words(t)) is not None]
            by_spots = pii.Counter(p for t in texts if wanted.plain_words(t) is not None for _, _, _, own in wanted.spots(t) for p in own)
            assert counted.count(plains) == by_spots
        plain, odd = plain + len(plains), odd + len(texts) - len(plains)
    assert plain > 800 and odd > 100
    assert pii.Wanted((), ["x"]).plain_words("x") is None
