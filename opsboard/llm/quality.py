"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in Arrow batches. The trees are fitted on at most `sample_rows`
labelled documents (those with the smallest hash of doc_id), kept as flat arrays in heap order, and
walked for all rows of a batch at once.

Defined results: a null text counts as empty; an empty text gets the statistics of an empty text and so
a score like any other; labels that are null or whose doc_id is null teach nothing; repeated labels of a
document are averaged, a tie counts as good; repeated documents are scored each; without labels every
score is 0.5; a document without doc_id is not held out; extra columns are ignored by `scores` and kept
by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import fresh, ship, sliced

SAMPLE_ROWS = 20_000
HELD_OUT = 1  # remainder of crc32(doc_id) by 3 that no label is learnt from

FEATURES = (
    "log_bytes", "upper", "digits", "spaces", "newlines", "periods", "commas", "exclamations", "bars", "symbols",
    "non_ascii", "byte_entropy", "log_words", "word_length", "distinct_words", "capital_words", "lines_per_word",
    "distinct_lines", "stop_like", "long_words",
)

_BYTES = np.zeros((9, 256), dtype=np.float64)
for _row, _chars in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*@^~<>=+\\/_{}[]",
)):
    _BYTES[_row, list(_chars)] = 1


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text, as float64."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    distinct = set(words)
    return np.array(
        [
            np.log1p(len(raw)),
            *(_BYTES @ counts / n),
            counts[128:].sum() / n,
            -(share * np.log2(share)).sum() if len(share) else 0.0,
            np.log1p(len(words)),
            sum(map(len, words)) / w,
            len(distinct) / w,
            sum(map(str.isupper, words)) / w,
            len(lines) / w,
            len(set(lines)) / len(lines),
            sum(len(x) <= 3 for x in words) / w,
            sum(len(x) > 20 for x in distinct) / w,
        ]
    )


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays [tree, node] in heap order: node k has the children 2k + 1, 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0) -> Forest:
    """Logistic boosting; each level finds its splits in histograms of gradients over feature bins."""
    inner, leaves = 2**depth - 1, 2**depth
    rate_good = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_good / (1 - rate_good)))
    shape = (trees, inner + leaves)
    forest = Forest(np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape), base, depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    n_features, margin = x.shape[1], np.full(len(y), base)
    offsets = np.arange(n_features) * bins
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * n_features * bins + offsets + binned).ravel()
            size = width * n_features * bins
            g, h = (
                np.bincount(cell, np.repeat(v, n_features), size).reshape(width, n_features, bins).cumsum(axis=2)
                for v in (gradient, hessian)
            )
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < 1) | (h_all - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, (at, won) in enumerate(zip(best, gain.reshape(width, -1).max(axis=1), strict=True)):
                f, b = divmod(int(at), bins)
                if won > 1e-6 and b < len(edges[f]):
                    forest.feature[tree, first + k], forest.threshold[tree, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[tree, node]] > forest.threshold[tree, node])
        g = np.bincount(node - inner, gradient, leaves)
        h = np.bincount(node - inner, hessian, leaves)
        forest.value[tree, inner:] = -rate * g / (h + l2)
        margin += forest.value[tree, node]
    return forest


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def _with_statistics(df: DataFrame, text: str, added: str) -> DataFrame:
    """`df` without its text, with the statistics as an array."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != text]

    def run(batches):
        for batch in sliced(batches):
            rows = [statistics(v.as_py()) for v in batch.column(text)]
            values = pa.array([v for row in rows for v in row], pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values)], [*names, added]
            )

    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(added, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most `sample_rows` documents that carry a label and are not held out.

    The label rows are cut to the bound before they are broadcast; what reaches the driver is one array
    of statistics for each of at most `sample_rows` documents.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), "quality")
        .filter(F.col("id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")
    sample = _with_statistics(texts, "text", "x").orderBy(F.xxhash64("id"), "id", "x").limit(sample_rows).toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["good"].to_numpy(np.float64))


def with_score(docs: DataFrame, forest: Forest, added: str = "score") -> DataFrame:
    """Every row of `docs` as it is, with the score of its whole text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in sliced(batches):
            x = np.array([statistics(v.as_py()) for v in batch.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x), pa.float64())], [*batch.schema.names, added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    forest = train(docs, labels, sample_rows)
    return with_score(docs.select("doc_id", "text"), forest).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    added = fresh(docs.columns, "score")
    scored = with_score(docs, train(docs, labels, sample_rows), added)
    return scored.filter(F.col(added) >= 0.5).select(*docs.columns)
