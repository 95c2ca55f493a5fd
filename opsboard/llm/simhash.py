"""SimHash near-duplicates: fingerprints that differ in at most two bits, found through per-segment bit counts.

* Fingerprint. Bit b is 1 if more than half of the 64-bit hashes (XXH64, seed 42) of all shingles of a text,
  repeats included, have it set.
* Embedding. A fingerprint is cut into 16 segments of four bits; the bit counts of the segments are a point
  of a lattice, packed into one long. One differing bit moves one count by one, so the Manhattan distance of
  two points is at most the Hamming distance of their fingerprints.
* Grid join. Every fingerprint goes to its own cell of the lattice and to the cells one step away (at most
  33). Two fingerprints meet in a cell exactly if their points are at most two steps apart; who meets nobody
  has no link and drops out here. A cell only needs the smallest and the largest fingerprint to know whether
  it holds several, so a crowded cell is a sum, not a group.
* Exact check. Two fingerprints differ in at most two bits exactly if some word of 64 bits is at most one bit
  from either. In each crowded cell a fingerprint therefore offers the words of that cell that are at most one
  bit away; those that offer the same word (65 at most) are linked to the smallest of them. This keeps all
  components, and a dense group of n near-copies makes at most 65 n links instead of n * n.

Components are found by joins over the link table; documents meet their class by a join that Spark can split.

Defined results: a null, empty or wordless text has the fingerprint zero and is linked like any other; a text
of fewer than three words is one shingle; a null doc_id is a document like any other but names no component
unless all of a component's are null; repeated rows are returned each; an empty table gives no rows; other
columns are not looked at (`one_of_each` keeps them). Texts are hashed in blocks, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import fresh, ship, sliced, written
from opsboard.llm.jaccard import components

WORDS = 3
SEED = 42
BITS = 2  # the exact check below is for two: a word between two fingerprints is one bit from each
SEGMENT = 4
BLOCK = 1 << 20  # bytes of text hashed at once

_NIBBLES = 0x1111111111111111
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + BLOCK)
        stop = found.start() if found else len(raw)
        yield raw[at:stop].split()
        at = stop


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """The 64 bits of a whole text as a signed number."""
    ones, n, rest = np.zeros(64, np.int64), 0, []
    for words in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = rest + words
        if len(words) >= width:
            hashes = _hashes(words, width)
            ones += _ones(hashes)
            n += len(hashes)
        rest = words[max(0, len(words) - width + 1) :]
    if not n and rest:
        ones, n = _ones(_hashes(rest, len(rest))), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", text: str = "text") -> DataFrame:
    """`docs` with the fingerprint of each text as a long."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in sliced(batches):
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], schema.names)

    return docs.mapInArrow(run, schema)


def segment_counts(bits: Column) -> Column:
    """The bit count of each segment, in the four bits of that segment: the point of a fingerprint."""
    return sum((F.shiftrightunsigned(bits, k).bitwiseAND(F.lit(_NIBBLES)) for k in range(1, SEGMENT)), bits.bitwiseAND(F.lit(_NIBBLES)))


def cells(point: Column) -> Column:
    """The lattice points at most one step from `point`, itself included."""
    near = [point]
    for at in range(0, 64, SEGMENT):
        count, step = F.shiftrightunsigned(point, at).bitwiseAND(F.lit(15)), F.lit(1 << at)
        near += [F.when(count < SEGMENT, point + step), F.when(count > 0, point - step)]
    return F.array_compact(F.array(*near))


def flips(bits: Column) -> Column:
    """All words of 64 bits at most one bit from `bits`, itself included."""
    masks = [1 << k for k in range(63)] + [-(1 << 63)]
    return F.array(bits, *[bits.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def links(prints: DataFrame) -> DataFrame:
    """(a, b) between fingerprints that differ in at most two bits, enough of them to keep all components.

    `prints` holds distinct fingerprints (`fingerprint`).
    """
    placed = prints.select("fingerprint", F.explode(cells(segment_counts(F.col("fingerprint")))).alias("cell"))
    met = placed.groupBy("cell").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).filter("low < high")
    crowded = placed.join(written(met.select("cell"), "simhash-cells"), "cell", "left_semi")
    offered = F.filter(flips(F.col("fingerprint")), lambda word: segment_counts(word) == F.col("cell"))
    words = crowded.select("fingerprint", F.explode(offered).alias("word"))
    # at most 65 fingerprints are within one bit of a word
    stars = words.groupBy("word").agg(F.collect_set("fingerprint").alias("around")).filter(F.size("around") > 1)
    pairs = stars.select(F.explode("around").alias("a"), F.array_min("around").alias("b")).distinct()
    return pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))


def _classes(rows: DataFrame, print_name: str) -> DataFrame:
    """fingerprint and component_id of all distinct fingerprints of `rows` (doc_id and a fingerprint)."""
    first = rows.groupBy(F.col(print_name).alias("fingerprint")).agg(F.min("doc_id").alias("first"))
    first = written(first, "simhash-distinct")
    labels = components(written(links(first.select("fingerprint")), "simhash-links"))
    labelled = labels.withColumnRenamed("node", "fingerprint")
    smallest = labelled.join(first, "fingerprint").groupBy("label").agg(F.min("first").alias("component_id"))
    linked = labelled.join(written(smallest, "simhash-components"), "label").select("fingerprint", "component_id", F.lit(True).alias("linked"))
    every = first.join(linked, "fingerprint", "left")
    named = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    return written(every.select("fingerprint", named), "simhash-classes")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every document."""
    rows = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "simhash-prints")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return rows.join(_classes(rows, "fingerprint"), "fingerprint").select("doc_id", digits, "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with the document of the smallest doc_id of each component; of repeated rows, one."""
    names = docs.columns
    name = fresh(names, "fingerprint")
    rows = written(with_fingerprint(docs, name), "simhash-documents")
    classes = _classes(rows.select("doc_id", name), name).select(F.col("fingerprint").alias(name), F.col("component_id").alias(fresh([*names, name], "component_id")))
    kept = rows.join(classes, name).filter(F.col("doc_id").eqNullSafe(classes[classes.columns[1]]))
    return kept.dropDuplicates(["doc_id"]).select(*names)
