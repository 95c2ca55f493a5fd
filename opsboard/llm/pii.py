"""Personal data: base patterns, then contextual extraction bootstrapped from what they find.

Four kinds are found by their form (email, ip, card, phone). These seeds induce lexical patterns, the words
next to them. A pattern may point at anything: an instance is the token next to it, or the run of short groups
(`123 45 6789`, an IBAN), whatever its length and characters. Spark keeps the graph of patterns and instances
as an edge table and scores it in rounds: a pattern by the scores of its instances, an instance by those of its
patterns. What patterns with a high score and enough seeds point at are further spans of the kind `identifier`.
Instances found so become seeds themselves when they are confident: their patterns' mean score is high too,
and such patterns find at least LEAST_SHARE of all their occurrences (else they are common words). All of it is
repeated, hop after hop, until no seed is new.

Each hop scans the texts for new patterns and new seeds only. The graph holds patterns with enough distinct
seeds that are LEAST_SHARE of what the pattern points at, so it has at most 1 / LEAST_SHARE edges for each
occurrence of a seed; common words are only counted. Less than that could reach the score only through
instances of other good patterns, and these are seeds in the next hop. What is sent to the workers are the
patterns that have enough seeds and the instances that those in the graph find.

Defined results: a null text counts as empty and has no spans; spans are code points, end exclusive;
kinds are searched apart and may overlap, further spans never overlap base ones; repeated documents get
the same spans each; without seeds there are no patterns and no further spans; extra columns are kept by
`redact`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import fresh, ship, sliced, written

KINDS = ("email", "ip", "card", "phone")
FURTHER = "identifier"
ROUNDS = 3
LEAST_SCORE = 0.8
LEAST_SEEDS = 5
LEAST_SHARE = 0.1
FEW = 64
NEAR = 64  # characters looked at first for the words around a span
MOST_WORDS = 100_000  # distinct words whose form is remembered

# The contract's patterns; possessive and anchored at the start of a run of digits, so that no text takes
# more than linear time. A match can't begin within such a run: what follows the run is the same.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;=|]+")
_ATOM = re.compile(r"[^\s\"'<>()\[\]{},;=|.:!?]+")
_RUN = re.compile(
    r"(?:[a-z]{2}[0-9]{2}(?: [a-z]{4})?(?: (?=[a-z]{0,3}[0-9])[a-z0-9]{1,4}){1,9}|[0-9]{1,6}(?: [0-9]{1,6}){1,9})"
    r"(?![^\s\"'<>()\[\]{},;=|.:!?])"
)
_MARK = re.compile(r"[\"'<>()\[\]{},;=|.:!?]")  # what may part a candidate from the word that holds it
_ANY_RUN = re.compile(r"(?<![^\s\"'<>()\[\]{},;=|])(?:" + _RUN.pattern + ")")


def _emails(text: str):
    if "@" not in text:
        return
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)


def _luhn(digits: list[int]) -> bool:
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {kind: [] for kind in KINDS}
    found["email"] = list(_emails(text))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found["phone"].append(m.span())
    return found


def folded(text: str) -> str:
    """`text` in lower case, with as many characters."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _around(plain: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to three words before and one after a span, whole ones, however long and far away."""
    reach = NEAR
    while True:
        first = max(0, start - reach)
        before = plain[first:start].split()
        if not first or len(before) > 3:  # the first word may be cut, and is not among the last three
            break
        reach *= 4
    reach = NEAR
    while True:
        after = plain[end : end + reach].split(None, 1)
        if end + reach >= len(plain) or len(after) > 1 or after and plain[end + reach - 1].isspace():
            break
        reach *= 4
    return before[-3:], after[:1]


def contexts(plain: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: one to three words before it, one after it. `plain` is folded, its digits made equal."""
    return _named(*_around(plain, start, end))


def _named(before: list[str], after: list[str]) -> list[str]:
    left = [f"before: {' '.join(before[-n:])}" for n in range(1, len(before) + 1)]
    return left + [f"after: {w}" for w in after]


def candidates(lower: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What a pattern may point at: tokens and runs of short groups, outside of `taken`."""
    taken, k, end = sorted(taken), 0, 0
    for m in _TOKEN.finditer(lower):
        start, token = m.span()
        if start < end:
            continue
        while token > start and lower[token - 1] in ".:!?":
            token -= 1
        if token == start:
            continue
        run = _RUN.match(lower, start) if lower[token : token + 1] == " " and lower[token - 1].isdigit() else None
        if run is None and not taken:
            end = token
            yield start, token
            continue
        for stop in (run.end(), token) if run else (token,):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if not (taken and any(s < stop and start < e for s, e in taken[k : k + len(KINDS)])):
                end = stop
                yield start, stop
                break


_FOUND = [
    *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS),
    T.StructField("base", T.StringType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("seen", T.ArrayType(T.StructType([T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))),
    T.StructField("digest", T.BinaryType()),
]
_SEEN = pa.list_(pa.struct([("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _scan(text: str | None) -> tuple:
    text = text or ""
    found = base_spans(text)
    spans = [(kind, s, e) for kind in KINDS for s, e in found[kind]]
    base = ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)
    lower = folded(text) if spans else ""
    plain = _DIGIT.sub("0", lower)
    seen = [{"instance": lower[s:e], "patterns": contexts(plain, s, e)} for _, s, e in spans]
    return (*(len(found[k]) for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(), seen, _digest(text))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and spans of the base kinds, the seeds with their contexts, and a digest of the text."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *_FOUND])
    kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), _SEEN, pa.binary()]

    def run(batches):
        for batch in sliced(batches):
            rows = [_scan(v.as_py()) for v in batch.column("text")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Wanted:
    """Patterns and instances to look for. A text that has no word of them is passed over."""

    def __init__(self, patterns: Iterable[str] = (), instances: Iterable[str] = ()):
        self.patterns, self.instances = frozenset(patterns), frozenset(instances)
        sides = [p.partition(": ") for p in self.patterns]
        self.last = frozenset(words.split()[-1] for side, _, words in sides if side == "before")
        self.first = frozenset(words for side, _, words in sides if side == "after")
        parts = [_ATOM.findall(w)[-1:] for w in self.last] + [_ATOM.findall(w)[:1] for w in self.first]
        self.words = frozenset(w for p in parts for w in p)
        self.heads = frozenset(w for i in self.instances for w in _ATOM.findall(i)[:1])
        self.always = not all(parts)

    def may_have(self, lower: str, plain: str) -> bool:
        if self.heads and not self.heads.isdisjoint(_ATOM.findall(lower)):
            return True
        # with many words to look for, nearly every text has one
        return bool(self.patterns) and (self.always or len(self.words) > FEW or not self.words.isdisjoint(_ATOM.findall(plain)))

    def plain_words(self, text: str) -> str | None:
        """The folded text, digits made equal, if patterns are wanted and each candidate is within one of its words."""
        if not self.patterns or self.instances:
            return None
        lower = folded(text)
        if not _DIGIT.search(lower):
            return None if "@" in text and any(_emails(text)) else lower
        if _ANY_RUN.search(lower) or any(base_spans(text).values()):
            return None
        return _DIGIT.sub("0", lower)

    def spots(self, text: str) -> Iterator[tuple[int, int, str, list[str]]]:
        """start, end, instance and patterns outside of base spans: the wanted patterns, or all of a wanted instance."""
        lower = folded(text)
        plain = _DIGIT.sub("0", lower)
        if not self.may_have(lower, plain):
            return
        taken = [span for spans in base_spans(text).values() for span in spans]
        if self.instances:
            for s, e in candidates(lower, taken):
                if lower[s:e] in self.instances:
                    yield s, e, lower[s:e], contexts(plain, s, e)
            return
        spans = [m.span() for m in _WORD.finditer(plain)]
        words, last, first = [plain[a:b] for a, b in spans], self.last, self.first
        k, n, begin, stop = -1, 0, 0, 0
        for s, e in candidates(lower, taken):
            while stop <= s:
                k += 1
                begin, stop = spans[k]
            # the word next to a candidate tells at once that most are beside no wanted pattern
            if (plain[begin:s] if begin < s else words[k - 1] if k else None) not in last:
                if e < stop:
                    after = plain[e:stop]
                else:
                    n = k + 1
                    while n < len(spans) and spans[n][1] <= e:
                        n += 1
                    if n == len(spans):
                        continue
                    after = plain[e : spans[n][1]] if spans[n][0] < e else words[n]
                if after not in first:
                    continue
            own = [p for p in contexts(plain, s, e) if p in self.patterns]
            if own:
                yield s, e, lower[s:e], own


class _Words(dict):
    """Numbers words by what they are to the wanted patterns, most alike; number 0 is no word. Only a word's form
    and the patterns matter, so that words that are neither wanted nor of a form of their own share a number."""

    def __init__(self, wanted: _Counted):
        super().__init__()
        self.wanted = wanted
        self.kinds = {(0, -1, False, False, (), ()): 0}

    def __missing__(self, word: str) -> int:
        words, first = self.wanted.words, self.wanted.first
        opens = closes = True  # whether a candidate begins, or ends, where the word does
        inner, later = [], []  # wanted words between a candidate and the word's start; patterns, and its end
        if _MARK.search(word):
            opens = closes = False
            for s, e in candidates(word, []):
                if not s:
                    opens = True
                elif (before := words.get(word[:s])) is not None:
                    inner.append(before)
                if e == len(word):
                    closes = True
                elif (after := first.get(word[e:])) is not None:
                    later.append(after)
        kind = words.get(word, 0), first.get(word, -1), opens, closes, tuple(inner), tuple(later)
        number = self[word] = self.kinds.setdefault(kind, len(self.kinds))
        return number


class _Counted:
    """How often wanted patterns stand beside candidates, many texts at a time.

    The words of the patterns before a candidate are the paths of a tree, from the first word on; a path may begin
    at each of the three words before a candidate. What `Wanted.spots` finds one by one is counted here by words,
    in texts without base spans and without runs: there a candidate lies within a word.
    """

    def __init__(self, patterns: Iterable[str]):
        self.names = sorted(patterns)
        self.first, self.words, self.edges, self.of_node = {}, {}, {}, {}
        for k, name in enumerate(self.names):
            side, _, text = name.partition(": ")
            if side == "after":
                self.first[text] = k
                continue
            node = 0
            for word in text.split():
                step = node, self.words.setdefault(word, len(self.words) + 1)
                node = self.edges.setdefault(step, len(self.edges) + 1)
            self.of_node[node] = k
        self.size = len(self.words) + 1
        ordered = sorted((node * self.size + word, child) for (node, word), child in self.edges.items())
        self.keys = np.array([-1, *(k for k, _ in ordered)], np.int64)
        self.children = np.array([0, *(c for _, c in ordered)], np.int64)
        self.depth = max((len(n.split()) - 1 for n in self.names if n.startswith("before")), default=0)
        self.known = _Words(self)

    def _step(self, nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The child of each node by each word; 0 is none, and the root at the start."""
        keys = nodes * self.size + words
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (words > 0), self.children[at], 0)

    def count(self, plains: list[str]) -> Counter:
        if len(self.known) > MOST_WORDS:
            self.known = _Words(self)
        numbers = [0, 0, 0]
        for plain in plains:
            numbers.extend(map(self.known.__getitem__, plain.split()))
            numbers += (0, 0, 0)
        ids = np.array(numbers, np.int64)
        *four, inner, later = zip(*self.known.kinds, strict=True)
        left, right, opens, closes = map(np.array, four)
        total = np.zeros(len(self.names) + 1, np.int64)  # the last one is of no pattern
        total += np.bincount(right[ids[1:][closes[ids[:-1]]]] % len(total), minlength=len(total))
        for k, times in enumerate(np.bincount(ids, minlength=len(later)).tolist()):
            for pattern in later[k]:
                total[pattern] += times
        at = np.flatnonzero(opens[ids])
        at = at[left[ids[at - 1]] > 0]
        self._paths(total, [left[ids[at - d]] for d in (3, 2, 1)])
        at = np.flatnonzero(np.array([len(x) for x in inner])[ids])
        own = [inner[k] for k in ids[at].tolist()]
        last = np.array([w for x in own for w in x], np.int64)
        at = np.repeat(at, [len(x) for x in own])
        self._paths(total, [left[ids[at - 2]], left[ids[at - 1]], last])
        return Counter({name: n for name, n in zip(self.names, total.tolist(), strict=False) if n})

    def _paths(self, total: np.ndarray, words: list[np.ndarray]) -> None:
        """Add the patterns that end with the last of these words, for each row of them."""
        for n in range(1, self.depth + 1):
            nodes, rest = np.zeros(len(words[0]), np.int64), words
            for k in range(3 - n, 3):
                nodes = self._step(nodes, rest[k])
                alive = nodes > 0  # a path that is lost does not begin anew
                nodes, rest = nodes[alive], [w[alive] for w in rest]
            for node, times in zip(*(x.tolist() for x in np.unique(nodes, return_counts=True)), strict=True):
                total[self.of_node.get(node, -1)] += times


def spots(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """Where texts have what is wanted: digest, start, end, instance, patterns."""
    ship(docs.sparkSession)
    schema = "digest binary, start int, end int, instance string, patterns array<string>"
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    names = ["digest", "start", "end", "instance", "patterns"]

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text"):
                text, digest = text.as_py() or "", None
                for spot in wanted.spots(text):
                    digest = digest or _digest(text)
                    rows.append((digest, *spot))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.select("text").mapInArrow(run, schema)


def tally(docs: DataFrame, wanted: Wanted) -> dict[str, int]:
    """How often each wanted pattern, or each wanted instance, occurs outside of base spans."""
    ship(docs.sparkSession)

    def run(batches):
        counts, counted = Counter(), _Counted(wanted.patterns)
        for batch in sliced(batches):
            plains = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                plain = wanted.plain_words(text)
                if plain is not None:
                    plains.append(plain)
                    continue
                for _, _, instance, own in wanted.spots(text):
                    counts.update(own if wanted.patterns else (instance,))
            if plains:
                counts.update(counted.count(plains))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["what", "n"])

    return dict(docs.select("text").mapInArrow(run, "what string, n long").groupBy("what").agg(F.sum("n")).collect())


def edges(seen: DataFrame) -> DataFrame:
    """Of `instance` and `patterns`: pattern, instance, and how often they meet."""
    exploded = seen.select("instance", F.explode("patterns").alias("pattern"))
    return exploded.groupBy("pattern", "instance").agg(F.count("*").cast("double").alias("n"))


def _of_instances(graph: DataFrame, scored: DataFrame) -> DataFrame:
    """instance and the mean score of its patterns, for those that are no seeds."""
    met = graph.filter(~F.col("seed")).join(scored, "pattern")
    return met.groupBy("instance").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("known"))


def patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score and the number of its distinct seeds, after `rounds` of scoring.

    A seed scores 1. A pattern's score is the mean of its instances', with one more of score 0; that of
    another instance the mean of its patterns', all weighted by how often they meet.
    """
    seeds = F.sum(F.col("seed").cast("int")).alias("seeds")
    score = (F.sum(F.col("n") * F.col("known")) / (F.sum("n") + 1)).alias("score")
    known = graph.withColumn("known", F.col("seed").cast("double"))
    scored = known.groupBy("pattern").agg(score, seeds)
    for _ in range(rounds - 1):
        others = graph.filter(~F.col("seed")).join(_of_instances(graph, scored), "instance").select("pattern", "seed", "n", "known")
        own = graph.filter("seed").select("pattern", "seed", "n", F.lit(1.0).alias("known"))
        scored = own.unionAll(others).groupBy("pattern").agg(score, seeds)
    return scored


def further_spans(docs: DataFrame, scanned: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """digest and the spans that confident patterns find in that text."""
    spark = docs.sparkSession
    strings = lambda found, name: spark.createDataFrame([(x,) for x in sorted(found)], f"{name} string")
    of_base = of_seeds = written(edges(scanned.select(F.explode("seen").alias("o")).select("o.*")), "pii-seeds")
    where = None  # the spots of all patterns in the graph
    pattern_counts, instance_counts = {}, {}
    graphed, seeds, good = set(), set(), set()
    while True:
        enough = of_seeds.groupBy("pattern").agg(F.count_distinct("instance").alias("seeds"), F.sum("n").alias("n"))
        enough = {r["pattern"]: r["n"] for r in enough.filter(F.col("seeds") >= least_seeds).collect()}
        unknown = enough.keys() - pattern_counts.keys()
        if unknown:
            own = of_base.join(strings(unknown, "pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.sum("n"))
            own, others = dict(own.collect()), tally(docs, Wanted(unknown))
            pattern_counts |= {p: own.get(p, 0) + others.get(p, 0) for p in unknown}
        worth = {p for p, n in enough.items() if n >= LEAST_SHARE * pattern_counts[p]} - graphed
        if not worth:
            break
        new = written(spots(docs, Wanted(worth)), "pii-spots")
        graphed |= worth
        where = new if where is None else where.unionAll(new)
        own = of_base.join(strings(graphed, "pattern"), "pattern", "left_semi").withColumn("base", F.lit(True))
        met = edges(where).withColumn("base", F.lit(False)).unionByName(own).groupBy("pattern", "instance")
        met = written(met.agg(F.sum("n").alias("n"), F.max("base").alias("base")), "pii-edges")
        while True:  # seeds that the graph at hand gives
            mark = strings(seeds, "instance").withColumn("marked", F.lit(True))
            graph = met.join(mark, "instance", "left").withColumn("seed", F.col("base") | F.coalesce("marked", F.lit(False)))
            graph = written(graph.select("pattern", "instance", "seed", "n"), "pii-graph")
            scored = written(patterns(graph, rounds), "pii-patterns")
            good = {r["pattern"] for r in scored.filter((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds)).collect()}
            sure = _of_instances(graph, scored).filter(F.col("known") >= least_score)
            found = where.join(sure, "instance", "left_semi").select("instance", "digest", "start", "end", F.explode("patterns").alias("pattern"))
            found = found.join(strings(good, "pattern"), "pattern", "left_semi").groupBy("instance", "digest", "start", "end")
            # A pattern sees a spot once for each copy of the text.
            found = found.agg((F.count("*") / F.count_distinct("pattern")).alias("n")).groupBy("instance").agg(F.sum("n"))
            found = dict(found.collect())
            unknown = found.keys() - instance_counts.keys()
            if unknown:
                instance_counts |= tally(docs, Wanted((), unknown))
            added = {i for i, n in found.items() if n >= LEAST_SHARE * instance_counts[i]} - seeds
            if not added:
                break
            seeds |= added
            of_seeds = of_seeds.unionAll(written(edges(spots(docs, Wanted((), added))), "pii-seeds"))
    if not good:
        return spark.createDataFrame([], "digest binary, further array<struct<start:int,end:int>>")
    spans = where.select("digest", "start", "end", F.explode("patterns").alias("pattern"))
    spans = spans.join(strings(good, "pattern"), "pattern", "left_semi").select("digest", "start", "end").distinct()
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("further"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans as text."""
    scanned = written(scan(docs), "pii-scan")  # spans and contexts, no texts
    extra = further_spans(docs, scanned, **options)
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base", "base_sha256", F.coalesce("further", none).alias("further")]
    listed = F.transform("further", lambda s: F.concat_ws(":", F.lit(FURTHER), s["start"].cast("string"), s["end"].cast("string")))
    every = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), listed)
    return scanned.join(extra, "digest", "left").select(*columns).select(
        "doc_id",
        *(f"n_{kind}" for kind in KINDS),
        "base_sha256",
        F.array_join(every, ",").alias("spans"),
        F.size("further").cast("long").alias("n_identifier"),
    )


def blanked(text: str, further: list[tuple[int, int]]) -> str:
    """`text` with each span replaced by its kind in brackets; where spans overlap, the first one's kind."""
    spans = [(s, e, kind.upper()) for kind, found in base_spans(text).items() for s, e in found]
    spans += [(s, e, FURTHER.upper()) for s, e in further]
    parts, end = [], 0
    for s, e, kind in sorted(spans):
        if s >= end:
            parts += (text[end:s], f"[{kind}]")
        end = max(end, e)
    return "".join(parts) + text[end:]


def redact(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its texts blanked; n_chars, where there is one, counts the new text."""
    ship(docs.sparkSession)
    scanned = written(scan(docs.select("doc_id", "text")).filter(F.size("seen") > 0).select("seen"), "pii-scan")
    extra = further_spans(docs, scanned, **options)
    names = docs.columns
    key, spans = fresh(names, "digest"), fresh(names, "further")
    extra = extra.select(F.col("digest").alias(key), F.col("further").alias(spans))
    joined = docs.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(extra, key, "left").drop(key)

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            more = batch.column(spans).to_pylist()
            new = [t if t is None else blanked(t, [(s["start"], s["end"]) for s in m or ()]) for t, m in zip(texts, more, strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                counts = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, new, strict=True)]
                columns["n_chars"] = pa.array(counts, kind)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return joined.mapInArrow(run, docs.schema)
