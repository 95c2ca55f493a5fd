"""Token counts that follow edits: a segment tree of pre-token counts for each document.

A document's pre-tokens (the pieces that byte-level merges never cross) are laid out in leaves of
`leaf_pretokens`; a tree in heap order holds the tokens of each leaf and the sums above them. An edit
re-encodes text from the last leaf that it can't have changed up to the first old leaf boundary that the new
pre-tokens meet again, writes the count into the first leaf of that region (the others become empty) and
updates the sums on the paths to the root. Everything is a narrow pass over rows; a row holds one document.

Why that is exact: the pre-token pattern has no look-behind, so matching from a boundary depends only on what
follows; it looks at most one character beyond the space that follows a match. A leaf that begins two
characters or more before an edit thus begins there after it too, and once a new match ends where an old leaf
begins, beyond the edit, the rest is as before.

Defined results: a null text counts as empty (no tokens, no leaf); edits are clipped to the text and taken in
order of start; one that begins within an earlier one begins where that ends; null edits, or edits with a
null start, do nothing; a null replacement is empty; a null end is the start; repeated documents are counted
each; extra columns are kept by `build` and `edited` unless they bear the name of an output column.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import ship, sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_PRETOKENS = 256
MOST_CACHED = 300_000  # counts that a worker remembers; beyond that it begins anew

_EDIT = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
)
_TREE = [T.StructField("leaf_ends", T.ArrayType(T.IntegerType())), T.StructField("tree", T.ArrayType(T.LongType()))]
_EDITED = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_tokens_after", T.LongType()),
    T.StructField("n_leaves", T.IntegerType()),
    T.StructField("leaves_touched", T.IntegerType()),
    T.StructField("chars_reencoded", T.LongType()),
]


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: bytes):
        super().__init__()
        pairs = map(bytes.split, ranks.splitlines())
        self.encode = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
        ).encode_ordinary
        self.matches = regex.compile(PATTERN).finditer
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def _counter(digest: str, vocabulary) -> Counter:
    return Counter(vocabulary.value)


class _Vocabulary:
    """The rank file, read once by the driver (its size is the vocabulary's) and sent to every executor."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.digest, self.value = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def counter(self) -> Counter:
        return _counter(self.digest, self.value)


def plant(counts: list[int]) -> np.ndarray:
    """The tree over leaf counts: node k holds the sum of nodes 2k and 2k + 1, leaves begin in its middle."""
    width = 1 << max(0, len(counts) - 1).bit_length()
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(counts)] = counts
    for level in range(width.bit_length() - 2, -1, -1):
        first = 1 << level
        tree[first : 2 * first] = tree[2 * first : 4 * first : 2] + tree[2 * first + 1 : 4 * first : 2]
    return tree


def grown(text: str, counter: Counter, leaf_pretokens: int = LEAF_PRETOKENS) -> tuple[np.ndarray, np.ndarray]:
    """leaf_ends and tree of a text."""
    pieces = counter.pieces(text)
    counts = np.fromiter(map(counter.__getitem__, pieces), np.int64, len(pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.arange(0, len(pieces), leaf_pretokens)
    if not len(first):
        return np.zeros(0, np.int64), plant([])
    return np.add.reduceat(lengths, first).cumsum(), plant(np.add.reduceat(counts, first).tolist())


def tidy(edits: list | None, n: int) -> list[tuple[int, int, str]]:
    """Edits in order, clipped, not overlapping."""
    done, reach = [], 0
    known = [e for e in edits or () if e and e["start"] is not None]
    for e in sorted(known, key=lambda e: (e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")):
        start = min(n, max(e["start"], reach, 0))
        end = max(start, min(n, e["start"] if e["end"] is None else e["end"]))
        done.append((start, end, e["text"] or ""))
        reach = end
    return done


def rewritten(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += (text[at:start], new)
        at = end
    return "".join(parts) + text[at:]


def regrown(text: str, ends: np.ndarray, tree: np.ndarray, edits: list[tuple[int, int, str]], counter: Counter):
    """New text, leaf_ends and tree after tidy edits; the leaves touched and the characters re-encoded."""
    new = rewritten(text, edits)
    if not len(ends):
        ends, tree = grown(new, counter) if new else (ends, tree)
        return new, ends, tree, len(ends), len(new)
    tree, width, starts = tree.copy(), len(tree) // 2, np.concatenate(([0], ends[:-1]))
    ends, touched, chars, k, shift = ends.copy(), set(), 0, 0, 0
    moved = 0  # by how much boundaries before this leaf have been moved already
    while k < len(edits):
        first = max(0, int(np.searchsorted(starts, edits[k][0] - 2, side="right")) - 1)
        at = int(starts[first]) + shift
        tokens, begin, leaf = 0, at, None
        shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
        goal = int(np.searchsorted(starts, edits[k][1], side="left"))
        for m in counter.matches(new, at):
            tokens += counter[m.group()]
            at = m.end()
            while leaf is None:
                while goal < len(starts) and starts[goal] + shift < at:
                    goal += 1
                if goal == len(starts) or k + 1 == len(edits) or starts[goal] <= edits[k + 1][0] - 2:
                    break
                k += 1  # the next edit can change what lies before this boundary: one region for both
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                goal = max(goal, int(np.searchsorted(starts, edits[k][1], side="left")))
            if goal < len(starts) and goal > first and starts[goal] + shift == at:
                leaf = goal
                break
        if leaf is None:  # to the end of the text, past all edits
            for edit in edits[k + 1 :]:
                shift += len(edit[2]) - (edit[1] - edit[0])
            k, leaf = len(edits) - 1, len(starts)
        chars += at - begin
        tree[width + first] = tokens
        tree[width + first + 1 : width + leaf] = 0
        ends[first:leaf] = at
        ends[leaf:] += shift - moved
        moved = shift
        touched.update(range(width + first, width + leaf))
        k += 1
    nodes = touched
    while nodes and max(nodes) > 1:
        nodes = {n // 2 for n in nodes}
        for n in nodes:
            tree[n] = tree[2 * n] + tree[2 * n + 1]
    return new, ends, tree, len(touched), chars


def _without(df: DataFrame, names: list[str]) -> DataFrame:
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def build(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_pretokens: int = LEAF_PRETOKENS) -> DataFrame:
    """`docs` with leaf_ends (characters) and tree (tokens) of its text."""
    ship(docs.sparkSession)
    words, docs = _Vocabulary(docs.sparkSession, vocabulary), _without(docs, [f.name for f in _TREE])
    names = [*docs.columns, *(f.name for f in _TREE)]

    def run(batches):
        counter = words.counter()
        for batch in sliced(batches):
            made = [grown(v.as_py() or "", counter, leaf_pretokens) for v in batch.column("text")]
            ends = pa.array([e.tolist() for e, _ in made], pa.list_(pa.int32()))
            trees = pa.array([t.tolist() for _, t in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ends, trees], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_TREE]))


def edited(indexed: DataFrame, edits: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of `build` after the edits in the column `edits`: new text, leaf_ends and tree, and the counts."""
    ship(indexed.sparkSession)
    words = _Vocabulary(indexed.sparkSession, vocabulary)
    indexed = _without(indexed, [f.name for f in _EDITED]).withColumn(edits, F.col(edits).cast(T.ArrayType(_EDIT)))
    given = indexed.columns
    names = [*given, *(f.name for f in _EDITED)]

    def run(batches):
        counter = words.counter()
        for batch in sliced(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            made = []
            for text, ends, tree, todo in zip(*(columns[c] for c in ("text", "leaf_ends", "tree", edits)), strict=True):
                text, ends, tree = text.as_py() or "", np.array(ends.as_py(), np.int64), np.array(tree.as_py(), np.int64)
                new, ends, after, touched, chars = regrown(text, ends, tree, tidy(todo.as_py(), len(text)), counter)
                made.append((new, ends.tolist(), after.tolist(), int(tree[1]) if len(tree) > 1 else 0, int(after[1]) if len(after) > 1 else 0, len(ends), touched, chars))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            columns |= dict(zip(("text", "leaf_ends", "tree"), arrays, strict=False))
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in given), *arrays[3:]], names)

    return indexed.mapInArrow(run, T.StructType([*indexed.schema.fields, *_EDITED]))


def sample_edits(text) -> F.Column:
    """Three edits of a text, at its quarters: a deletion, a replacement and an insertion."""
    n = F.length(F.coalesce(text, F.lit("")))

    def edit(share: int, gone: int, new: str) -> F.Column:
        start = F.floor(n * share / 4).cast("int")
        return F.struct(start.alias("start"), F.least(n, start + gone).alias("end"), F.lit(new).alias("text"))

    return F.array(edit(1, 7, ""), edit(2, 5, " edit 42 "), edit(3, 0, " (see the note)"))
