"""Benchmark decontamination: windows of normalised benchmark words, looked up in document windows.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. A window is `size`
consecutive words of an item; a shorter item is one window. The windows are a hash set that goes to every
task: each document window is looked up by a hash of its first and last word, and then verified as a whole.
What is hit leaves as word spans, from which documents or spans are removed.

The set is broadcast in the plan only up to `most_windows` windows, a documented bound on its size. Beyond
it the document windows' hashes are joined with those of the benchmark by a shuffle, and verified after it;
the result is the same. All of it is DataFrame functions.

Defined results: null, empty or wordless texts have no words and no hit; wordless items have no window and
never occur; items with equal texts occur together; a null item_id is a benchmark row without an id, whose
words are hit but which is not counted; repeated document rows are judged each; an empty benchmark hits
nothing; extra columns are kept by `clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsboard.llm.common import written

SIZE = 10
MOST_WINDOWS = 50_000
# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text. Java tests a class of single characters with one
# look into a bit set, ten times as fast as a chain of ranges, so the characters between words are listed.
_BETWEEN = [chr(c) for c in range(128) if not chr(c).isalnum()]
WORD = f"[^{''.join(f'\\x{ord(c):02X}' for c in _BETWEEN)}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(text.isNull(), "").when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _window(tokens: Column, at: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(tokens, at, length), " ")


def _starts(tokens: Column, length: int) -> Column:
    """Word numbers (from 1) at which a window of `length` begins."""
    return F.when(F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - (length - 1))).otherwise(F.array().cast("array<int>"))


def _ends_hash(first: Column, last: Column) -> Column:
    return F.xxhash64(first, last)


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, window, length and hash (of its first and last word): one row per item and window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1))
    each = items.select("item_id", "w", "length", starts.alias("at"))
    return each.select(
        "item_id",
        _window(F.col("w"), F.col("at"), F.col("length")).alias("window"),
        "length",
        _ends_hash(F.element_at("w", F.col("at")), F.element_at("w", F.col("at") + F.col("length") - 1)).alias("hash"),
    ).distinct()


def _hits_in_set(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """`docs` (with words `w`) and its hits, looked up in literal hash sets."""
    rows = windows.select("length", "hash", "window").distinct().collect()  # at most most_windows

    def hits_of(length: int) -> Column:
        hashes = sorted({r["hash"] for r in rows if r["length"] == length})
        texts = sorted({r["window"] for r in rows if r["length"] == length})

        def hit(at: Column) -> Column:
            ends = _ends_hash(F.col("w")[at - 1], F.col("w")[at + (length - 2)])
            return ends.isin(hashes) & _window(F.col("w"), at, length).isin(texts)

        starts = F.filter(_starts(F.col("w"), length), hit)
        return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(length).alias("length")))

    found = [hits_of(length) for length in sorted({r["length"] for r in rows})]
    none = F.array().cast("array<struct<at:int,length:int>>")
    return docs.withColumn("hits", F.array_sort(F.concat(*found)) if found else none)


def _hits_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same hits by shuffles: hashes of document windows meet those of the benchmark, then the
    documents with a meeting verify it against the windows themselves."""
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most `size` numbers
    hashes = windows.select("length", "hash").distinct()
    none = F.array().cast("array<struct<at:int,length:int>>")

    def starts_of(length: int) -> DataFrame:
        def pick(at: Column) -> Column:
            ends = _ends_hash(F.col("w")[at - 1], F.col("w")[at + (length - 2)])
            return F.struct(at.alias("at"), F.lit(length).alias("length"), ends.alias("hash"))

        return docs.select("key", F.explode(F.transform(_starts(F.col("w"), length), pick)).alias("p")).select("key", "p.*")

    possible = [starts_of(length) for length in sorted(lengths)]
    if not possible:
        return docs.withColumn("hits", none)
    met = reduce(DataFrame.unionAll, possible).distinct().join(hashes, ["length", "hash"], "left_semi")
    per_doc = met.groupBy("key").agg(F.collect_list(F.struct("at", "length")).alias("met"))  # at most a few per word of one document
    spelled = (
        docs.dropDuplicates(["key"])
        .join(per_doc, "key")
        .select("key", "w", F.explode("met").alias("m"))
        .select("key", "m", _window(F.col("w"), F.col("m.at"), F.col("m.length")).alias("window"))
    )
    sure = spelled.join(windows.select("window").distinct(), "window", "left_semi")
    hits = sure.groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("hits"))
    return docs.join(hits, "key", "left").withColumn("hits", F.coalesce("hits", none))


def _n_hit(hits: Column) -> Column:
    """Words inside any hit: hits are in order, so only the reach so far matters."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def step(done: Column, hit: Column) -> Column:
        end = hit["at"] + hit["length"] - 1
        reach = F.greatest(done["reach"], end)
        return F.struct(reach.alias("reach"), (done["n"] + reach - F.greatest(done["reach"], F.least(hit["at"] - 1, reach))).alias("n"))

    return F.aggregate(hits, start, step)["n"]


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_windows: int = MOST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """`docs` as a column `row`, with key (of doc_id and text), words w and hits; and the windows."""
    windows = benchmark_windows(benchmark, size)
    n = windows.limit(most_windows + 1).count()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # A generated column is computed once: Spark would copy the expression of a plain one into each filter and lambda.
    tokens = rows.select("row", F.explode(F.array(words(F.col("row.text")))).alias("w"))
    if n <= most_windows:
        return _hits_in_set(tokens, windows), windows
    keyed = tokens.withColumn("key", F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256))
    return _hits_by_join(keyed, windows), windows


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, windows = with_hits(docs.select("doc_id", "text"), benchmark, size, most_windows)
    hit_windows = F.array_distinct(F.transform("hits", lambda h: _window(F.col("w"), h["at"], h["length"])))
    judged = found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("w").cast("long").alias("n_words"),
        _n_hit(F.col("hits")).alias("n_hit"),
        F.when(F.size("hits") > 0, F.array_sort(hit_windows)).alias("hit_windows"),
    )
    judged = judged.withColumn("passage", F.when(F.col("hit_windows").isNotNull(), F.sha2(F.array_join("hit_windows", "\n"), 256)))
    judged = written(judged, "decontamination")  # without texts; the documents are scanned once
    # Documents with the same windows name the same items, so each set of windows is looked up once.
    sets = judged.filter(F.col("passage").isNotNull()).groupBy("passage").agg(F.first("hit_windows").alias("hit_windows"))
    named = sets.select("passage", F.explode("hit_windows").alias("window")).join(
        windows.filter(F.col("item_id").isNotNull()).select("item_id", "window"), "window"
    )
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    items = named.groupBy("passage").agg(ids.alias("ids"))
    # Most documents have no passage: they would meet under one null key, so they pass by the join.
    hit = judged.filter(F.col("passage").isNotNull()).join(items, "passage", "left")
    others = judged.filter(F.col("passage").isNull()).withColumn("ids", F.array().cast("array<string>"))
    columns = ["doc_id", "n_words", "n_hit", "ids"]
    return hit.select(*columns).unionAll(others.select(*columns)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """`docs` without its contaminated documents, or (remove="spans") without their hit words: a hit word
    goes with what follows it up to the next word; n_chars, where there is one, then counts what is left."""
    found, _ = with_hits(docs, benchmark, size, most_windows)
    if remove == "documents":
        return found.filter(F.size("hits") == 0).select("row.*")
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    text = F.col("row.text")
    apart = F.split(text, WORD, -1)
    as_written = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    inside = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    left = F.concat(
        F.col("apart")[0],
        F.array_join(
            F.transform(
                F.filter(F.sequence(F.lit(1), F.size("as_written")), lambda i: ~F.array_contains(F.col("inside"), i)),
                lambda i: F.concat(F.col("as_written")[i - 1], F.col("apart")[i]),
            ),
            "",
        ),
    )
    opened = found.withColumns({"apart": apart, "as_written": as_written, "inside": F.array_distinct(inside)})
    cut = opened.withColumn("cleaned", F.when(F.size("hits") == 0, text).otherwise(left))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("cleaned").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.size("hits") == 0, F.col("row.n_chars")).otherwise(F.length("cleaned").cast(kind)).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return cut.select(*columns)
