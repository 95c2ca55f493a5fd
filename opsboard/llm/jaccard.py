"""N-gram Jaccard join: a metric-space join of shingle sets, exact, with regions around pivots.

The distance is 1 - |x & y| / |x | y|, a metric; two sets link within `radius` 0.25 of each other.

* Equal sets are one node (a 64-bit digest of the sorted shingle hashes names it).
* Regions. A shingle alone is a set at distance 1 - 1/|x| from every x that holds it and at 1 from all
  others, so single shingles, in one global order, divide the space: a set lies nearest to its shingles, the
  first of them being its cell. If x and y link, y lacks less than a quarter of x's shingles, so the two
  meet in a region of their first |x| - ceil(0.75 |x|) + 1 shingles: sets near a boundary are replicated
  into that window of regions and no pair is lost. The order puts shingles of many sets last (counted over
  all of them), which keeps passages that many documents share from making large regions.
* Pivots. In each region the node with the smallest name is the pivot; all others there are held against it.
  Who links with it shares its component; members of one component are not compared any more. The nodes that
  meet a pivot in any region are its cell: what meets in a region meets in the cell of its pivot.
* Recursion. Cells that still hold several components go on, first with the likeliest pair of each component
  in a cell, then with what is left. A cell of at most CELL nodes is joined where it lies. A larger one is
  divided: the distance (bits that differ between sketches of a fixed size, a metric, and never more than the
  shingles that differ) of its nodes to a pivot puts them into rings as wide as two linked sets may differ; by
  the triangle inequality partners lie in the same ring or the next, so nodes near a ring's inner edge are
  replicated into the ring inside. Rings are cells of their own, with another pivot. What rings cannot divide
  (LEVELS deep) meets in blocks, all of it but the largest component with everything.
* Exact. Pairs that sizes and sketches leave are held against each other shingle by shingle.

Links stay edges in tables; components are found by joins (smallest label, with pointer jumping), in rounds
that each end as a table in the shared folder. Regions of a shingle that many documents hold are grouped by
sums and joins that Spark can split; the others meet in parts of the hash space, whose number grows with the
number of documents. Shingles are compared by 64-bit hashes.

Defined results: a null, empty or wordless text has no shingles and links with nothing; with fewer than five
words the whole sequence is one shingle; a null doc_id is a document like any other, but names no component
unless all of a component's are null; repeated rows are returned each; extra columns are kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import fresh, ship, sliced, written

WORDS = 5
RADIUS = 0.25
HOT = 64  # documents with a shingle, beyond which its region is taken by sums and joins
SLOTS = 1 << 22  # of the table of frequent shingles that goes to every executor, a byte each
DOCS_PER_PART = 4_000
BLOCK = 1 << 20  # bytes of text hashed at once
BITS = 1 << 24  # of the filter on documents whose sets are needed
CELL = 256  # nodes joined in one place
LEVELS = 2  # of rings within rings
FOLD = 16  # longs of a sketch of fixed size

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as far as asked for."""

    def __init__(self):
        self.of, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of) < n:
            size = max(n, 1 << 16)
            base = np.full(size, _BASE)
            base[0] = 1
            under = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            under[0] = 1
            self.of, self.inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(under, dtype=np.uint64)
        return self.of[:n], self.inverse[:n]


_POWERS = _Powers()


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverse = _POWERS.upto(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _blocks(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about BLOCK bytes that end where a word ends."""
    at = 0
    while at < len(raw):
        stop = at + BLOCK
        while stop < len(raw) and not _SPACE[raw[stop]]:
            stop += 1
        yield raw[at:stop]
        at = stop


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts = [_word_hashes(block) for block in _blocks(raw)]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = _mixed(total * _BASE + hashes[k : k + n])
    return np.unique(total)


def name_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def window(found: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    """The shingles whose regions a set is replicated into: its first quarter and one, in the global order."""
    n = len(found)
    size = n - (3 * n + 3) // 4 + 1
    if levels is not None:
        level = levels[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
        if level.any():
            found = found[np.argsort(level, kind="stable")]
    return found[:size]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both, by which a document is found again."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _parts_of(values: np.ndarray, others: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, sorted low halves of the hashes, other column) of each part of the hash space."""
    part, low = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), values.astype(np.uint32)
    order = np.lexsort((low, part))
    part, low, others = part[order], low[order], others[order]
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(part[a]), _narrow(low[a:b]), others[a:b].tobytes()


def _narrow(low: np.ndarray) -> bytes:
    """Sorted numbers as steps, byte planes apart: the upper planes are all but empty and compress away."""
    return np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _widened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _blobs(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    part, low, other = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(part, pa.int32()), "low": pa.array(low, pa.binary()), "other": pa.array(other, pa.binary())}
    )


_BLOBS = "part int, low binary, other binary"


def _joined(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    low = np.concatenate([_widened(x) for x in table["low"].to_pylist()])
    return low, np.frombuffer(b"".join(table["other"].to_pylist()), kind)


def frequent(docs: DataFrame, parts: int, hot: int = HOT) -> np.ndarray | None:
    """A level for each slot of the hash space: 0, or how far above `hot` a shingle of that slot is counted.

    Every shingle of every document is counted. Shingles that share a slot share a level, which changes the
    order of shingles alike for all sets and thus no result. At most SLOTS small rows reach the driver.
    """

    def count(batches):
        for batch in sliced(batches):
            found = [shingles(t.as_py()) for t in batch.column("text")]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield _blobs(list(_parts_of(values, np.minimum(n, 65_535).astype(np.uint16), parts)))

    def add(table: pa.Table) -> pa.Table:
        low, n = _joined(table, np.uint16)
        order = np.argsort(low, kind="stable")
        low, first = np.unique(low[order], return_index=True)
        total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        many = total > hot
        level = np.minimum(250, np.log2(np.maximum(total[many], 1) / hot).astype(np.int64) + 1)
        return pa.table({"slot": pa.array((low[many] & np.uint32(SLOTS - 1)).astype(np.int32)), "level": pa.array(level.astype(np.int32))})

    counted = docs.select("text").mapInArrow(count, _BLOBS).groupBy("part").applyInArrow(add, "slot int, level int")
    rows = counted.groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    if not rows.num_rows:
        return None
    levels = np.zeros(SLOTS, np.uint8)
    levels[rows["slot"].to_numpy()] = rows["level"].to_numpy()
    return levels


def sketch(found: np.ndarray) -> bytes:
    """A bit per shingle, in about two bits of room for each, or that of a fold."""
    room = min(1 << 20, max(64 * FOLD, 1 << (2 * len(found) - 1).bit_length()))
    bits = np.zeros(room, bool)
    bits[(found & np.uint64(room - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Bits that differ, the larger sketch folded to the smaller: no more than the shingles that do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _hot(chosen: np.ndarray, levels: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(chosen), bool) if levels is None else levels[(chosen & np.uint64(SLOTS - 1)).astype(np.int64)] > 0


def named(docs: DataFrame, levels) -> DataFrame:
    """doc_id, key, n, sid, bits (the sketch) and hot, the frequent shingles of its window, of each document."""
    fields = [("key", T.LongType()), ("n", T.LongType()), ("sid", T.LongType()), ("bits", T.BinaryType()), ("hot", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        frequent_ones = levels.value if levels is not None else None
        for batch in sliced(batches):
            rows = []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                chosen = window(found, frequent_ones)
                hot = chosen[_hot(chosen, frequent_ones)].astype(np.int64).tolist()
                rows.append((len(found), name_of(found), sketch(found), hot or None))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def regions_of(docs: DataFrame, known: DataFrame, parts: int, levels) -> DataFrame:
    """(region, sid) of the regions with several nodes."""

    def place(batches):
        frequent_ones = levels.value if levels is not None else None
        for batch in sliced(batches):
            values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column("text"):
                found = shingles(text.as_py())
                if len(found):
                    chosen = window(found, frequent_ones)
                    values.append(chosen[~_hot(chosen, frequent_ones)])
                    owners.append(np.full(len(values[-1]), name_of(found), np.int64))
            yield _blobs(list(_parts_of(np.concatenate(values), np.concatenate(owners), parts)))

    def meet(table: pa.Table) -> pa.Table:
        low, sid = _joined(table, np.int64)
        order = np.lexsort((sid, low))
        low, sid = low[order], sid[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (sid[1:] != sid[:-1])
        low, sid = low[new], sid[new]
        _, group, size = np.unique(low, return_inverse=True, return_counts=True)
        many = size[group] > 1
        part = np.int64(table["part"][0].as_py())
        return pa.table({"region": pa.array((part << np.int64(32)) | low[many].astype(np.int64)), "sid": pa.array(sid[many])})

    few = docs.select("text").mapInArrow(place, _BLOBS).groupBy("part").applyInArrow(meet, "region long, sid long")
    # Frequent shingles: made one per (shingle, node) before the shuffle, joined rather than gathered.
    hot_rows = known.filter("hot IS NOT NULL").select("sid", F.explode("hot").alias("region")).select("region", "sid").distinct()
    hot_rows = written(hot_rows, "jaccard-frequent")
    several = hot_rows.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1").select("region")
    # Parts number their regions from 0 upwards; the sign tells the regions of frequent shingles apart.
    own = hot_rows.join(several, "region", "left_semi").select(F.col("region").bitwiseOR(F.lit(-(2**63))).alias("region"), "sid")
    return written(few.unionAll(own), "jaccard-regions")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and shingles of the nodes in `wanted` (sid), each taken from one of its documents.

    A bit filter of fixed size over the keys of those documents spares the others the hashing; what it lets
    through in error, or for repeated rows, is not asked for or is made one.
    """
    keys = written(nodes.join(wanted.distinct(), "sid", "left_semi").select("sid", "key"), "jaccard-keys")
    slot = F.pmod(F.col("key"), F.lit(BITS)) + 1  # bit positions count from 1
    bits = np.zeros(BITS // 8, np.uint8)
    filled = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    for row in filled.collect():  # at most BITS bits
        at = (row["b"] - 1) * len(row["bits"])
        bits[at : at + len(row["bits"])] = np.frombuffer(bytes(row["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in sliced(batches):
            key = batch.column("key").to_numpy()
            found = [shingles(batch.column("text")[int(i)].as_py()) for i in np.flatnonzero(_asked(sent.value, key))]
            found = [f for f in found if len(f)]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name_of(f) for f in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["sid", "items"],
            )

    found = docs.select("key", "text").mapInArrow(run, "sid long, items array<long>")
    return written(found, "jaccard-sets").repartition("sid").dropDuplicates(["sid"])


def _asked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key % BITS
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1


def near(pairs: DataFrame, sketches: DataFrame, radius: float) -> DataFrame:
    """The pairs (a, b) that may lie within `radius`: what surely lies beyond by size or sketch goes."""
    one = sketches.select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
    two = sketches.select(F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    close = F.least("a_n", "b_n") >= (1 - radius) * F.greatest("a_n", "b_n")
    joined = pairs.join(two, "b").join(one, "a").filter(close)

    def run(batches):
        for batch in sliced(batches):
            a, b, a_n, b_n, a_bits, b_bits = (batch.column(c).to_pylist() for c in ("a", "b", "a_n", "b_n", "a_bits", "b_bits"))
            gap = np.array([least_difference(x, y) for x, y in zip(a_bits, b_bits, strict=True)], np.float64)
            both = np.array(a_n, np.float64) + np.array(b_n, np.float64)
            keep = pa.array(both - gap >= (1 - radius) * (both + gap) - 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def with_folds(nodes: DataFrame) -> DataFrame:
    """sid, n and fold, a sketch in FOLD longs: the parts of a longer one laid over each other."""

    def run(batches):
        for batch in sliced(batches):
            folds = [np.bitwise_or.reduce(np.frombuffer(b, "<i8").reshape(-1, FOLD), axis=0) for b in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(folds, pa.list_(pa.int64()))], ["sid", "n", "fold"])

    return nodes.select("sid", "n", "bits").mapInArrow(run, "sid long, n long, fold array<long>")


def divided(cells: DataFrame, level: int, most: int = CELL) -> DataFrame:
    """`cells` (cell, sid, label, n, fold) with those of more than `most` nodes divided into rings.

    Linked sets differ in at most a seventh of their sizes' sum, hence by no more in their distances to a pivot.
    """
    large = cells.groupBy("cell").agg(
        F.count("*").alias("size"), F.min_by("fold", F.xxhash64("sid", F.lit(level))).alias("pivot"), F.floor(2 * F.max("n") / 7).alias("reach")
    )
    large = written(large.filter(F.col("size") > most).drop("size"), "jaccard-large")
    rest = cells.join(large.select("cell"), "cell", "left_anti")
    apart = F.aggregate(F.zip_with("fold", "pivot", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    placed = cells.join(large, "cell").withColumn("apart", apart).withColumn("ring", F.floor(F.col("apart") / (F.col("reach") + 1)))
    # who lies within reach of the ring inside is replicated into it
    inner = (F.col("ring") > 0) & (F.col("apart") - F.col("ring") * (F.col("reach") + 1) < F.col("reach"))
    rings = F.when(inner, F.array("ring", F.col("ring") - 1)).otherwise(F.array("ring"))
    split = placed.select(F.explode(rings).alias("ring"), "cell", "sid", "label", "n", "fold")
    return rest.unionByName(split.select(F.xxhash64("cell", F.lit(level), "ring").alias("cell"), "sid", "label", "n", "fold"))


def blocked(cells: DataFrame, most: int = CELL) -> DataFrame:
    """`cells` with those of more than `most` nodes as pairs of blocks: every two nodes of different labels meet in
    a pair, but nodes outside the largest label meet all others, those in it only them."""
    labels = cells.groupBy("cell", "label").agg(F.count("*").alias("c"))
    sizes = labels.groupBy("cell").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("most"))
    sizes = sizes.filter(F.col("size") > most).select(
        "cell",
        F.col("most.label").alias("main"),
        F.ceil((F.col("size") - F.col("most.c")) * 2 / most).alias("few"),
        F.ceil(F.col("most.c") * 2 / most).alias("many"),
    )
    sizes = written(sizes, "jaccard-blocks")
    rest = cells.join(sizes.select("cell"), "cell", "left_anti")
    apart = F.col("label") != F.col("main")
    # blocks 0 to few - 1 hold the nodes outside the main label, few to few + many - 1 those in it
    own = F.when(apart, F.pmod(F.xxhash64("sid"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("sid"), F.col("many")))
    others = F.when(apart, F.sequence(F.lit(0).cast("long"), F.col("few") + F.col("many") - 1)).otherwise(
        F.when(F.col("few") > 0, F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).otherwise(F.array().cast("array<long>"))
    )
    placed = cells.join(sizes, "cell").withColumn("own", own).withColumn("other", F.explode(others))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return rest.unionByName(placed.select(pair.alias("cell"), "sid", "label", "n", "fold"))


def _met(sid: np.ndarray, label: np.ndarray, n: np.ndarray, fold: np.ndarray, cell: np.ndarray, best: bool) -> np.ndarray:
    """Pairs of rows (sorted by cell) of one cell and two labels that size and fold leave; with `best`, for each
    label of a cell only the pair that seems nearest."""
    found, shares = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    offset = 1
    while offset < len(cell):
        at = np.flatnonzero(cell[offset:] == cell[:-offset])
        if not len(at):
            break
        at = at[label[at] != label[at + offset]]
        low, high = np.minimum(n[at], n[at + offset]), np.maximum(n[at], n[at + offset])
        at = at[4 * low >= 3 * high]
        for k in range(0, len(at), 1 << 14):
            one = at[k : k + (1 << 14)]
            gap = np.bitwise_count(fold[one] ^ fold[one + offset]).sum(axis=1, dtype=np.int64)
            both = n[one] + n[one + offset]
            near = 7 * gap <= both
            found.append(np.stack((one[near], one[near] + offset), axis=1))
            shares.append(gap[near] / both[near])
        offset += 1
    pairs, share = np.concatenate(found), np.concatenate(shares)
    if best and len(pairs):
        side, which = pairs.T.ravel(), np.tile(np.arange(len(pairs)), 2)
        order = np.lexsort((share[which], label[side], cell[side]))
        side, which = side[order], which[order]
        first = np.ones(len(side), bool)
        first[1:] = (cell[side[1:]] != cell[side[:-1]]) | (label[side[1:]] != label[side[:-1]])
        pairs = pairs[np.unique(which[first])]
    return np.unique(np.sort(sid[pairs], axis=1), axis=0)


def candidates(cells: DataFrame, best: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that share a cell, as far as size and fold leave them; with `best`
    the likeliest one of each label and cell.

    Cells are at most a few times CELL nodes large; a task sorts its cells and holds some of them at a time.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            cell, sid, label, n = (table[c].to_numpy() for c in ("cell", "sid", "label", "n"))
            fold = table["fold"].combine_chunks().flatten().to_numpy().reshape(-1, FOLD).view(np.uint64)
            pairs = _met(sid, label, n, fold, cell, best)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cell)) + 1
            if held and held[-1].column("cell")[held[-1].num_rows - 1].as_py() != cell[0]:
                yield flush()
                held.clear()
            elif len(starts):  # the cell that was begun ends in this batch
                held.append(batch.slice(0, int(starts[0])))
                yield flush()
                held.clear()
                batch, starts = batch.slice(int(starts[0])), starts[1:] - starts[0]
            if len(starts):
                whole = batch.slice(0, int(starts[-1]))
                held.append(whole)
                yield flush()
                held.clear()
                batch = batch.slice(int(starts[-1]))
            held.append(batch)
        if held:
            yield flush()

    dealt = cells.select("cell", "sid", "label", "n", "fold").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (shingles in common), any (in either) of each pair."""
    one = sets.select(F.col("sid").alias("a"), F.col("items").alias("a_items"))
    two = sets.select(F.col("sid").alias("b"), F.col("items").alias("b_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    joined = pairs.join(two, "b").join(one, "a")
    return joined.select("a", "b", both.alias("both"), (F.size("a_items") + F.size("b_items") - both).alias("any"))


def _links() -> F.Column:
    return F.lit(100) * F.col("both") >= F.lit(75) * F.col("any")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node it reaches) of the nodes of an edge table (a, b)."""
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = written(lower.join(ahead, "label").select("node", F.least("label", "beyond").alias("label"), "old"), "labels")
        changed = after.filter("label < old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, hot: int = HOT, most: int = CELL) -> DataFrame:
    """Every document row: doc_id, key, n_shingles and component (a node name; null without shingles)."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs)
    parts = max(32, rows.count() // DOCS_PER_PART)
    levels = frequent(rows, parts, hot)
    sent = spark.sparkContext.broadcast(levels) if levels is not None else None
    known = written(named(rows, sent), "jaccard-names")
    regions = regions_of(rows, known, parts, sent)
    # one row a node, made before any join, so that a third of all documents in one node is a row like others
    nodes = known.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("bits").alias("bits"))
    nodes = written(nodes.join(regions.select("sid").distinct(), "sid", "left_semi"), "jaccard-nodes")

    def linked(pairs: DataFrame, what: str) -> DataFrame:
        """The pairs that link."""
        open_pairs = written(near(pairs, nodes, RADIUS), f"jaccard-{what}")
        if not open_pairs.limit(1).count():
            return spark.createDataFrame([], "a long, b long")
        sets = sets_of(rows, nodes, open_pairs.select(F.col("a").alias("sid")).unionAll(open_pairs.select("b")))
        return written(distances(open_pairs, sets).filter(_links()).select("a", "b"), f"jaccard-{what}-links")

    # Each node of a region against the region's pivot. That settles pivots that have one other node.
    pivots = regions.groupBy("region").agg(F.min("sid").alias("b"))
    stars = written(regions.join(written(pivots, "jaccard-pivots"), "region").filter("sid <> b").select(F.col("sid").alias("a"), "b").distinct(), "jaccard-stars")
    links = linked(stars, "stars")
    labels = components(links)

    # The nodes around a pivot are a cell. Cells of several components go on.
    folds = written(with_folds(nodes), "jaccard-folds")
    for best in (True, False):  # what most likely links comes first, so that less is left to be told apart
        placed = stars.select(F.col("b").alias("cell"), F.col("a").alias("sid")).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
        placed = placed.withColumn("label", F.coalesce("label", "sid"))
        mixed = placed.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cell")
        cells = written(placed.join(written(mixed, "jaccard-mixed"), "cell", "left_semi").join(folds, "sid"), "jaccard-cells")
        for level in range(LEVELS):
            cells = divided(cells, level, most)
        more = linked(candidates(blocked(cells, most), best), "candidates")
        if more.limit(1).count():
            links = links.unionAll(more)
            labels = components(links)
    own = known.filter("sid IS NULL").withColumn("component", F.lit(None).cast("long"))
    some = known.filter("sid IS NOT NULL").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    some = some.withColumn("component", F.coalesce("label", "sid"))
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), "component"]
    return some.select(*columns).unionAll(own.select(*columns))


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    found = written(classes(docs, hot), "jaccard-classes")
    smallest = found.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    smallest = written(smallest, "jaccard-smallest")  # both sides of the join are tables: a large component can be split
    some = found.filter("component IS NOT NULL").join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    return some.unionAll(found.filter("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id (of equal ids, the smallest
    key); documents without shingles all stay, as do documents without a doc_id that are alone. Rows that
    repeat the doc_id and text of the one that stays leave only one row."""
    found = written(classes(docs), "jaccard-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = found.filter("component IS NOT NULL").groupBy("component").agg(first).select(F.col("first.key").alias("kept"))
    names = docs.columns
    key = fresh(names, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    without = found.filter("component IS NULL").select(F.col("key").alias("kept")).distinct()
    stays = keyed.join(without, F.col(key) == F.col("kept"), "left_semi")
    single = keyed.join(kept, F.col(key) == F.col("kept"), "left_semi").dropDuplicates([key])
    return stays.unionAll(single).select(*names)
