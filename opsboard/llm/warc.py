"""WARC archives by way of a chunked record table.

A record is a run of rows (record_id, chunk_no, data, digest): chunks of at most `chunk_bytes` of its
payload, each with the SHA-256 of the payload so far, so no step after the split needs a whole payload and
the last chunk's digest is the payload's. A chunk is written as a WARC segment: the first as `response`,
further ones as `continuation` with WARC-Segment-Number, the last with WARC-Segment-Total-Length. Spark's
text sink writes the segments, one gzip file per task, through the file system that the folder names; the
reader streams each file line by line, takes blocks by their Content-Length, and gives the same table.

Of records with equal payloads of at least `least_bytes` bytes the smallest key is the response and the
others are `revisit` records without payload. Which payloads repeat is counted by digest before anything
is joined; only digests that occur twice or more take part in the join.

Defined results: a null payload is empty; an empty payload has one chunk of no bytes; a null key is
written as `null`, is never what others refer to unless all are null, in which case all are responses;
rows with the same smallest key are all responses; line breaks in a URL are escaped; a null URL has no
WARC-Target-URI; an empty table gives an empty archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard.llm.common import ship

CHUNK_BYTES = 64 * 1024
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time; a fixed one keeps archives repeatable
BREAK = "\r\n"

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("length", T.LongType()),  # bytes of the payload so far; of a revisit, the whole payload's
        T.StructField("digest", T.StringType()),  # of the payload so far; of a revisit, the whole payload's
        T.StructField("last", T.BooleanType()),
    ]
)


def decided(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """key, url, payload, digest and refers_to (null for a response)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest")
    )
    again = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("key").alias("origin"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "origin")
    )
    other = ~F.col("origin").eqNullSafe(F.col("key")) & F.col("origin").isNotNull()
    return rows.join(again, "digest", "left").select("key", "url", "payload", "digest", F.when(other, F.col("origin")).alias("refers_to"))


def to_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of `decided` rows; a record's chunks are neighbours, in order."""
    ship(records.sparkSession)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                key, url, payload, digest, origin = (batch.column(c)[row] for c in ("key", "url", "payload", "digest", "refers_to"))
                yield from _split(key.as_py(), url.as_py(), payload.as_buffer(), digest.as_py(), origin.as_py(), chunk_bytes)

    return records.select("key", "url", "payload", "digest", "refers_to").mapInArrow(run, CHUNKS)


def _name(key) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def _split(key, url, payload, digest, origin, chunk_bytes):
    total = len(payload)
    if origin is not None:
        yield _batch([(_name(key), "revisit", _name(origin), url, 0, b"", total, digest, True)])
        return
    so_far, view = hashlib.sha256(), memoryview(payload)
    for number in range(max(1, -(-total // chunk_bytes))):
        data = view[number * chunk_bytes : (number + 1) * chunk_bytes]
        so_far.update(data)
        end = number * chunk_bytes + len(data)
        kind = "continuation" if number else "response"
        yield _batch([(_name(key), kind, None, url, number, bytes(data), end, so_far.hexdigest(), end == total)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], CHUNKS.names)


def _line(name: str, value) -> F.Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def write(chunks: DataFrame, folder: str) -> None:
    """Write the chunk table as gzipped WARC files. A block's end is two line breaks; the sink adds the second."""
    first, ended, revisit = F.col("chunk_no") == 0, F.col("last"), F.col("record_type") == "revisit"
    segmented = ~(first & ended)
    target = F.regexp_replace(F.regexp_replace("target", "\r", "%0D"), "\n", "%0A")
    own = F.concat(F.rtrim(F.col("record_id"), F.lit(">")), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(own)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", target),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Segment-Number", F.when(segmented, F.col("chunk_no") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _line("WARC-Segment-Total-Length", F.when(segmented & ended, F.col("length"))),
        _line("WARC-Payload-Digest", F.when(ended, F.concat(F.lit("sha256:"), F.col("digest")))),
        _line("X-Payload-Length", F.when(revisit, F.col("length"))),
        _line("Content-Length", F.octet_length("data")),
        F.lit(BREAK),
    )
    text = F.concat(head.cast("binary"), F.col("data"), F.lit(BREAK.encode()).cast("binary")).cast("string")
    chunks.select(text.alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the archives in `folder`. A gzip file is one task's stream, never one buffer."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary").alias("line"))

    def run(batches):
        yield from parsed(line.as_py() for batch in batches for line in batch.column(0))

    return lines.mapInArrow(run, CHUNKS)


def parsed(lines):
    """Batches of chunk rows from the lines (without their ends) of whole archives, one after another."""
    lines, state = iter(lines), {}
    for line in lines:
        if line.rstrip(b"\r") != b"WARC/1.1":
            if line.strip(b"\r"):
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        fields = {}
        for raw in lines:
            name, _, value = raw.rstrip(b"\r").decode("utf-8", "surrogatepass").partition(":")
            if not name:
                break
            fields[name.lower()] = value.strip()
        yield _batch([_row(fields, _block(lines, int(fields["content-length"])), state)])


def _block(lines, length: int) -> bytes:
    """The next `length` bytes; the rest of their last line must be its end."""
    parts, left = [], length + len(BREAK)
    while left > 0:
        piece = next(lines, None)
        if piece is None:
            raise ValueError("an archive ends within a record")
        parts.append(piece)
        parts.append(b"\n")
        left -= len(piece) + 1
    block = b"".join(parts)
    if left < 0 or block[length:] != BREAK.encode():
        raise ValueError("a block is longer than its Content-Length")
    return block[:length]


def _row(fields: dict, block: bytes, state: dict) -> tuple:
    """A chunk row; `state` carries the digest of the record under way from segment to segment."""
    kind, number = fields["warc-type"], int(fields.get("warc-segment-number", 1))
    name = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    url = fields.get("warc-target-uri")
    if kind == "revisit":
        return name, kind, fields.get("warc-refers-to"), url, 0, b"", int(fields.get("x-payload-length", 0)), stated, True
    if number == 1:
        state.update(name=name, next=1, digest=hashlib.sha256(), length=0)
    if (state.get("name"), state.get("next")) != (name, number):
        raise ValueError(f"segment {number} of {name} is out of order")
    state["digest"].update(block)
    state["length"] += len(block)
    state["next"] += 1
    last = "warc-segment-number" not in fields or "warc-segment-total-length" in fields
    digest = state["digest"].hexdigest()
    if last and stated and stated != digest:
        raise ValueError(f"the payload of {name} does not have its digest")
    return name, kind, None, url, number - 1, block, state["length"], digest, last


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: no chunk is gathered."""
    key = lambda c: F.regexp_extract(c, "^<urn:record:(.*)>$", 1)
    return chunks.filter("last").select(
        F.when(key("record_id") != "null", key("record_id")).alias("key"),
        F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), key("refers_to")).alias("refers_to"),
    )
