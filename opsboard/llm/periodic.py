"""Periodic runs of words: every maximal repetition of a text, exactly.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 q) long, that no neighbouring word
extends keeping the period. The texts of a batch are laid end to end, shortest first, with a number that
occurs nowhere else between two texts, so that no run crosses and numpy works on all of them at once.

* Periods below SHORT: direct scans. For each lag, stretches of words equal to the word one lag on.
* Longer periods, scale by scale (Q = 64, 128, ...; periods Q to 2 Q - 1). Every stretch of k = Q / 4 words has a
  hash. A stretch that is the smallest of some window of k neighbours is a minimizer. A window inside a run
  comes again, period by period, and so does its minimizer: equal minimizers Q to 2 Q - 1 apart seed a run,
  which is extended both ways. In a window all stretches of which repeat within k / 2 words (they lie in runs
  of short period, which are known by then) nothing is a minimizer; elsewhere equal stretches are over k / 2
  apart, so a minimizer has few partners and the work is linear in the text.
* What is left: runs both halves of which lie in runs of one short period d. Those two then touch, and the
  words tell in which phase: each period of that phase up to the shorter one's length makes a run.

Extension compares hashes of stretches by halving; each run found is then held against the words themselves. Of
equal stretches the one with the smallest period stays: the others are multiples of it.

Defined results: a null, empty or wordless text has no words and no runs; a null doc_id is kept as it is (and
`echoed` leaves its words alone); repeated rows are answered each; an empty table gives no rows; other columns are not
looked at. Texts are taken whole: memory is about 100 bytes for each word of the longest text at hand.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opsboard.llm.common import ship, sliced

LEAST = 12
SHORT = 64  # first scale; a quarter of it must not be below LEAST, so that short runs are known as runs

_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in about a tenth of the documents with a tail that repeats: known periods to look for."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


class _Hashes:
    """Hashes of all stretches of a sequence, from sums of its numbers times powers of an odd base."""

    _of, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        if len(_Hashes._of) < n:
            of, inverse = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
            of[0] = inverse[0] = 1
            _Hashes._of, _Hashes._inverse = np.cumprod(of, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        values = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(29)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * _Hashes._of[: n - 1], dtype=np.uint64, out=self.sums[1:])
        self.n = len(ids)

    def at(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self._inverse[start]

    def all_of(self, size: int, lo: int) -> np.ndarray:
        """Of the stretches of `size` that start at `lo` or later."""
        found = (self.sums[lo + size :] - self.sums[lo : self.n - size + 1]) * self._inverse[lo : self.n - size + 1]
        found = (found ^ (found >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)  # mixed, so the order is by chance
        return found ^ (found >> np.uint64(29))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from a on equal those from b on (a < b)."""
        length = np.zeros(len(a), np.int64)
        step = 1 << max(1, self.n).bit_length()
        while step:
            may = np.flatnonzero(b + length + step <= self.n)
            same = self.at(a[may] + length[may], step) == self.at(b[may] + length[may], step)
            length[may[same]] += step
            step >>= 1
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before a equal those before b (a < b)."""
        length = np.zeros(len(a), np.int64)
        step = 1 << max(1, self.n).bit_length()
        while step:
            may = np.flatnonzero(a - length - step >= 0)
            same = self.at(a[may] - length[may] - step, step) == self.at(b[may] - length[may] - step, step)
            length[may[same]] += step
            step >>= 1
        return length


def _at_lag(ids: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of the stretches of period q that are long enough."""
    at = np.flatnonzero(ids[q:] == ids[:-q])
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.flatnonzero(np.diff(at) > 1) + 1
    start, end = at[np.concatenate(([0], new))], at[np.concatenate((new - 1, [len(at) - 1]))] + 1 + q
    keep = end - start >= max(LEAST, 2 * q)
    return np.stack((start[keep], end[keep], np.full(int(keep.sum()), q)), axis=1)


def _primitive(found: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over each window of `width`, a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(hashes: _Hashes, known: np.ndarray, scale: int, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of equal minimizers `scale` to twice as far apart, from `lo` on."""
    k = scale // 4
    values = hashes.all_of(k, lo)
    if len(values) < 2 * k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    zones = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k) & (known[:, 0] >= lo)]
    inside = np.zeros(len(values) + 1, np.int32)
    np.add.at(inside, zones[:, 0] - lo, 1)
    np.add.at(inside, zones[:, 1] - k + 1 - lo, -1)
    values[np.cumsum(inside[:-1]) > 0] = _TOP
    least = _sliding(values, k, np.minimum)
    edge = np.zeros(k - 1, np.uint64)
    picked = np.flatnonzero((_sliding(np.concatenate((edge, least, edge)), k, np.maximum) == values) & (values != _TOP))
    values, picked = values[picked], picked + lo
    order = np.lexsort((picked, values))
    values, picked = values[order], picked[order]
    starts, lags, offset = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while offset < len(picked):
        lag = picked[offset:] - picked[:-offset]
        close = (values[offset:] == values[:-offset]) & (lag < 2 * scale)
        if not close.any():
            break
        close &= lag >= scale
        starts.append(picked[:-offset][close])
        lags.append(lag[close])
        offset += 1
    return np.concatenate(starts), np.concatenate(lags)


def _touching(hashes: _Hashes, known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of the runs that two touching runs of one short period make."""
    long = known[(known[:, 2] <= scale // 8) & (known[:, 1] - known[:, 0] >= scale)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    one, two = long[:-1], long[1:]
    touch = np.flatnonzero((one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1]))
    starts, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (a, b, d), (c, e, _) in zip(one[touch].tolist(), two[touch].tolist(), strict=True):
        phases = np.arange(b - 2 * d, b - d)
        same = phases[hashes.at(phases, d) == hashes.at(np.array([c]), d)]
        if len(same):
            first = scale + (c - int(same[0]) - scale) % d
            lag = np.arange(first, min(2 * scale - 1, b - a, e - c) + 1, d)
            lags.append(lag)
            starts.append(np.maximum(a, c - lag))
    return np.concatenate(starts), np.concatenate(lags)


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of a sequence, by start and period.

    `ids` are texts of ascending `sizes` laid end to end, each followed by a number that occurs once.
    """
    most = int(sizes[-1]) if len(sizes) else 0
    found = [np.zeros((0, 3), np.int64), *(_at_lag(ids, q) for q in range(1, min(SHORT - 1, most // 2) + 1))]
    known = _primitive(np.concatenate(found))
    if most < 2 * SHORT:
        return known
    hashes = _Hashes(ids)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    scale = SHORT
    while 2 * scale <= most:
        lo = int(begins[np.searchsorted(sizes, 2 * scale)])
        at, lag = (np.concatenate(x) for x in zip(_seeds(hashes, known, scale, lo), _touching(hashes, known, scale), strict=True))
        start, end = at - hashes.behind(at, at + lag), at + lag + hashes.ahead(at, at + lag)
        fit = end - start >= 2 * lag
        runs = np.unique(np.stack((start[fit], end[fit], lag[fit]), axis=1), axis=0)
        right = np.array([np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in runs.tolist()], bool)
        wrong = [_at_lag(ids, q) for q in np.unique(runs[~right, 2]).tolist()]  # hashes alike by chance
        known = _primitive(np.concatenate([known, runs[right], *wrong]))
        scale *= 2
    return known


def _of_batch(texts: list[list[bytes]]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each text."""
    sizes = np.array([len(words) for words in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    every = pa.array(list(itertools.chain.from_iterable(texts[i] for i in order)), pa.binary())
    codes = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sorted_sizes = sizes[order]
    begins = np.concatenate(([0], np.cumsum(sorted_sizes + 1)))
    ids = np.empty(len(codes) + len(texts), np.int64)
    between = np.zeros(len(ids), bool)
    between[begins[1:] - 1] = True
    ids[~between] = codes
    ids[between] = len(codes) + np.arange(len(texts))
    runs = find_runs(ids, sorted_sizes)
    bounds = np.searchsorted(runs[:, 0], begins)
    out: list[np.ndarray] = [runs[:0]] * len(texts)
    for place, i in enumerate(order.tolist()):
        mine = runs[bounds[place] : bounds[place + 1]]
        out[i] = np.stack((mine[:, 0] - begins[place], mine[:, 1] - mine[:, 0], mine[:, 2]), axis=1)
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that a run repeats."""
    if not len(runs):
        return b" ".join(words)
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, runs[:, 0] + runs[:, 2], 1)
    np.add.at(over, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(itertools.compress(words, (np.cumsum(over[:-1]) == 0).tolist()))


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed: the text's
    words, one space apart, without what a run repeats after its first period.

    `rewrite` may change the words of a document, given its doc_id, before they are searched.
    """
    ship(docs.sparkSession)
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())]
    )

    def run(batches):
        for batch in sliced(batches):
            keys, texts = batch.column("doc_id"), []
            for key, text in zip(keys, batch.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                texts.append(rewrite(key.as_py(), words) if rewrite else words)
            found = _of_batch(texts)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], list(_RUN.names))
            kept = pa.array([_kept(w, f) for w, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts), kept], schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
