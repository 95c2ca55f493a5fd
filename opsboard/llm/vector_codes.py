"""Codes of vector parts: product quantisation in whole numbers, its search for the nearest entry by LAESA.

Each component x becomes floor(1024 x); a vector is cut into four consecutive parts (equal ones where its length
is a multiple of four). Each part position has a codebook, begun with that part of the 256 smallest vec_ids; rounds
of assigning every part to its nearest entry and replacing entries by the floored means of their parts follow.

* Pivots. Of the first codebook of a position, a few entries that lie far apart are fixed as pivots. The
  squared distance of every part to them is computed once and kept with the vectors, in the shared folder.
* Bounds. A round takes the distances of its entries to the pivots. By the triangle inequality an entry e is no
  nearer to a part x than the largest | d(x, p) - d(e, p) | over the pivots p.
* Search. The entries of a part are tried in the order of these bounds, a few at a time, with their exact whole
  distance, until the next bound is above the best distance found. Ties go to the lower index, so entries whose
  bound just reaches the best are tried too. Bounds are floating-point, with room for their rounding; every
  distance that decides is a whole number.
* Means. A task adds up the parts of each entry; those sums, as many as the codebooks have components, meet
  in a Spark sum and give the driver the next codebooks.

Vectors of unlike lengths have codebooks of their own, by length; lengths together beyond MOST_COMPONENTS are
refused, because codebooks go to every executor. So are components beyond 2^25, whose squares would not fit.

Defined results: vectors that are null or hold null, NaN or infinite components are left out, as are
none else: an empty vector has empty parts, code 00000000 and error 0; of repeated vec_ids each row is
coded, and the codebook starts with the smaller vector; null vec_ids come last; with fewer than 256 vectors
the codebooks have fewer entries; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import ship, sliced, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 12
STEP = 16  # entries tried at a time
ROWS = 1024  # parts searched at a time
LIMIT = 1 << 25
MOST_COMPONENTS = 1 << 16  # of all vector lengths that occur, together

Books = dict[int, list[np.ndarray]]  # by vector length: the entries of each part position


def bounds(size: int) -> list[int]:
    """Where the parts of a vector of `size` components begin and end."""
    return [k * size // PARTS for k in range(PARTS + 1)]


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, size and items (whole components) of the vectors that take part."""
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    large = F.exists("items", lambda c: F.abs(c) > LIMIT)
    refused = F.raise_error(F.lit(f"a component beyond {LIMIT // SCALE}")).cast("array<long>")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    rows = vectors.filter(good).select("vec_id", "label", F.size(x).alias("size"), whole.alias("items"))
    return rows.withColumn("items", F.when(large, refused).otherwise(F.col("items")))


def first_books(rows: DataFrame) -> Books:
    """The parts of the smallest vec_ids of each vector length: at most 256 rows for each reach the driver."""
    lengths = [r["size"] for r in rows.groupBy("size").count().limit(MOST_COMPONENTS + 2).collect()]
    if sum(lengths) > MOST_COMPONENTS:
        raise ValueError(f"vectors of {len(lengths)} lengths: codebooks too large to send to every executor")
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "items")
    few = rows.select("vec_id", "size", "items", F.row_number().over(order).alias("place")).filter(F.col("place") <= ENTRIES)
    books: Books = {}
    by_size: dict[int, list] = {}
    for row in few.orderBy("size", "place").select("size", "items").collect():
        by_size.setdefault(row["size"], []).append(row["items"])
    for size, items in by_size.items():
        whole, cut = np.array(items, np.int64).reshape(len(items), size), bounds(size)
        books[size] = [whole[:, a:b] for a, b in zip(cut, cut[1:], strict=False)]
    return books


def far_apart(book: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries of a codebook that lie far apart: the first, then always that farthest from those taken."""
    chosen = [0]
    nearest = ((book - book[0]) ** 2).sum(axis=1)
    while len(chosen) < most and nearest.max(initial=0) > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((book - book[chosen[-1]]) ** 2).sum(axis=1))
    return book[chosen]


def squares(parts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part to each of a few others."""
    return np.stack([((parts - o) ** 2).sum(axis=1) for o in others], axis=1)


def nearest(parts: np.ndarray, near: np.ndarray, book: np.ndarray, book_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each part, and how many distances were computed.

    `near` and `book_near` are the distances of parts and entries to the pivots.
    """
    index, best, tried = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max), 0
    for at in range(0, len(parts), ROWS):
        mine, dist = parts[at : at + ROWS], near[at : at + ROWS]
        bound = np.zeros((len(mine), len(book)))
        for p in range(dist.shape[1]):
            np.maximum(bound, np.abs(dist[:, p, None] - book_near[None, :, p]), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        open_rows = np.arange(len(mine))
        for step in range(0, len(book), STEP):
            entries = order[open_rows, step : step + STEP]
            gap = book[entries] - mine[open_rows, None, :]
            exact = np.einsum("nkd,nkd->nk", gap, gap)
            tried += exact.size
            low = exact.min(axis=1)
            entry = np.where(exact == low[:, None], entries, len(book)).min(axis=1)
            rows = at + open_rows
            better = (low < best[rows]) | ((low == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = low[better], entry[better]
            if step + STEP >= len(book):
                break
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-9) + 1e-6
            open_rows = open_rows[bound[open_rows, step + STEP] <= reach]
            if not len(open_rows):
                break
    return index, best, tried


def _by_size(batch: pa.RecordBatch):
    """(length, which rows, their components) of the vectors of each length in a batch."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == size)
        items = batch.column("items").take(pa.array(which)).flatten().to_numpy()
        yield size, which, items.reshape(len(which), size)


def with_pivots(rows: DataFrame, pivots: Books) -> DataFrame:
    """`rows` with `near`: the squared distances of each part to the pivots of its position."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*rows.schema, T.StructField("near", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in sliced(batches):
            near: list = [None] * batch.num_rows
            for size, which, items in _by_size(batch):
                cut = bounds(size)
                found = np.concatenate([squares(items[:, a:b], p) for a, b, p in zip(cut, cut[1:], sent.value[size], strict=False)], axis=1)
                for k, i in enumerate(which.tolist()):
                    near[i] = found[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema)


def _searched(batch: pa.RecordBatch, books: Books, pivots: Books):
    """(length, which rows, position, parts, index, squared distance) of all parts of a batch."""
    near_all = batch.column("near")
    for size, which, items in _by_size(batch):
        cut, begin = bounds(size), 0
        near = np.sqrt(near_all.take(pa.array(which)).flatten().to_numpy().reshape(len(which), -1).astype(np.float64))
        for part, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            pivot, book, parts = pivots[size][part], books[size][part], items[:, a:b]
            book_near = np.sqrt(squares(book, pivot).astype(np.float64))
            index, error, _ = nearest(parts, near[:, begin : begin + len(pivot)], book, book_near)
            begin += len(pivot)
            yield size, which, part, parts, index, error


def next_books(rows: DataFrame, books: Books, pivots: Books) -> Books:
    """The codebooks with each used entry replaced by the floored mean of its parts."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((books, pivots))
    names = ("size", "part", "entry", "pos", "total", "n")

    def add(batches):
        sums: dict = {}
        for batch in sliced(batches):
            for size, _, part, parts, index, _ in _searched(batch, *sent.value):
                if (size, part) not in sums:
                    book = sent.value[0][size][part]
                    sums[size, part] = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
                total, n = sums[size, part]
                np.add.at(total, index, parts)
                n += np.bincount(index, minlength=len(n))
        for (size, part), (total, n) in sums.items():
            entry, pos = (x.ravel() for x in np.indices(total.shape))
            used = n[entry] > 0
            columns = [np.full(int(used.sum()), size), np.full(int(used.sum()), part), entry[used], pos[used], total.ravel()[used], n[entry][used]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], list(names))

    sums = rows.select("size", "items", "near").mapInArrow(add, ", ".join(f"{n} long" for n in names))
    means = sums.groupBy("size", "part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    found = {size: [book.copy() for book in parts] for size, parts in books.items()}
    for row in means.toArrow().to_pylist():  # as many rows as the codebooks have components
        found[row["size"]][row["part"]][row["entry"], row["pos"]] = row["total"] // row["n"]
    return found


def coded(rows: DataFrame, books: Books, pivots: Books) -> DataFrame:
    """vec_id, label, size, code (two hex digits a part) and error (squared distances, summed over the parts)."""
    sent = rows.sparkSession.sparkContext.broadcast((books, pivots))
    schema = T.StructType([*rows.select("vec_id", "label", "size").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in sliced(batches):
            codes, errors = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for _, which, part, _, index, error in _searched(batch, *sent.value):
                codes[which, part] = index
                errors[which] += error
            digits = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:3]), pa.array(digits, pa.string()), pa.array(errors)], schema.names)

    return rows.mapInArrow(run, schema)


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books, Books]:
    """The vectors with their pivot distances, as a table, the codebooks after all rounds, and the pivots."""
    ship(vectors.sparkSession)
    rows = scaled(vectors)
    books = first_books(rows)
    pivots = {size: [far_apart(book) for book in parts] for size, parts in books.items()}
    rows = written(with_pivots(rows, pivots), "codes-vectors")
    for _ in range(rounds if books else 0):
        books = next_books(rows, books, pivots)
    return rows, books, pivots


def digest(parts: list[np.ndarray]) -> str:
    """SHA-256 of all components of the codebooks of one length, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in parts for x in book.ravel().tolist()).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    rows, books, pivots = train(vectors)
    found = written(coded(rows, books, pivots), "codes")
    sums = written(found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    digests = F.create_map(*[F.lit(x) for size, parts in books.items() for x in (size, digest(parts))]) if books else F.create_map().cast("map<int,string>")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.try_element_at(digests, F.col("size")).alias("codebooks_sha256")
    )
