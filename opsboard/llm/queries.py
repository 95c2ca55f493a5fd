"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsboard.llm import (
    ann,
    chat,
    decontaminate,
    jaccard,
    periodic,
    pieces,
    pii,
    quality,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
    warc,
)
from opsboard.llm.common import new_path, table
from opsboard.plans.catalog import Query


def sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text (with U+2581 as a space)."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(pieces.SPACE), F.lit(" ")))
    return pieces.decode(encoded).select(
        "doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "ids", same.alias("round_trip")
    )


def chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_path(spark, "warc")
    warc.write(warc.to_chunks(warc.decided(pages, "page_id", "url", "html")), folder)
    kind = pages.schema["page_id"].dataType
    found = warc.records(warc.read(spark, folder))
    return found.select(
        F.col("key").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages))
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, and how much of it was encoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    indexed = token_counts.build(docs).withColumn("edits", token_counts.sample_edits(F.col("text")))
    return token_counts.edited(indexed, "edits").select("doc_id", "n_tokens", "n_tokens_after", "n_leaves", "leaves_touched", "chars_reencoded")


def bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def vector_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, in a tenth of them of a tail that repeats; the longest one, and digests."""
    found = periodic.runs(table(spark, sf_dir, "documents"), periodic.echoed)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("of")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.at")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.of")).alias("period"),
        F.expr("1000 * best.length div -best.of").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages),
sized AS (SELECT page_id, digest, octet_length(encode(body)) AS payload_bytes FROM p),
origins AS (SELECT digest, min(page_id) AS origin FROM sized WHERE payload_bytes >= 100 GROUP BY digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM sized LEFT JOIN origins USING (digest)
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS window
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, row_number() OVER () AS rn, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT rn, n, i, array_to_string(w[i : i + n - 1], ' ') AS window
  FROM (SELECT rn, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths)),
hits AS (SELECT rn, a.n, i, item_id FROM spots a JOIN windows v ON a.window = v.window AND a.n = v.n),
covered AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn),
found AS (
  SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rn) LEFT JOIN found USING (rn)
"""

JACCARD_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and means, spelled out as one table each."""

    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT rn, part, min(d * 256 + entry) // 256 AS d, min(d * 256 + entry) % 256 AS entry FROM (
    SELECT rn, part, entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d
    FROM c JOIN b{r} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""

    def means(r: int) -> str:
        return f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
    FROM c JOIN a{r} USING (rn, part) GROUP BY ALL) m USING (part, entry, pos))"""

    tables = ",".join(assigned(r) + "," + means(r) for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS MATERIALIZED (
  SELECT rn, (i - 1) * 4 // len(embedding) AS part, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x,
    (i - 1) % (len(embedding) // 4) AS pos
  FROM (SELECT rn, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, rn AS entry, pos, x FROM c WHERE rn < 256),{tables},{assigned(rounds)},
codes AS (
  SELECT rn, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM codes JOIN v USING (rn)
"""


QUERIES: dict[str, Query] = {
    "op1_sentencepiece_scan": Query(sentencepiece_scan),
    "op2_chat_perspectives": Query(chat_perspectives),
    "op3_forest_neighbours": Query(forest_neighbours),
    "op4_warc_chunks": Query(warc_chunks, WARC_SQL),
    "op5_url_trees": Query(url_trees),
    "op6_decontamination": Query(decontamination, DECONTAMINATION_SQL),
    "op7_quality_trees": Query(quality_trees),
    "op8_edited_counts": Query(edited_counts),
    "op9_jaccard_regions": Query(jaccard_regions, JACCARD_SQL),
    "op10_bootstrapped_pii": Query(bootstrapped_pii),
    "op11_vector_pivots": Query(vector_pivots, _codes_sql()),
    "op12_simhash_segments": Query(simhash_segments),
    "op13_periodic_runs": Query(periodic_runs),
}
