"""The queries opN_<name>, their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as sh
from . import bpe, dedup, licenses, near_dup, packing, quality, sharding, topk, url_filter, warc


def vocabulary(name: str) -> str:
    """The path of a file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(sh.table(spark, sf_dir, "embeddings"))
    return topk.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(sh.table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sh.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, sh.table(spark, sf_dir, "pages"))


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.interleaved(sh.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(sh.table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(sh.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sh.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, sh.table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(sh.table(spark, sf_dir, "documents"))


def _number(text: str) -> str:
    """16 bits of the text's MD5, in SQL of Spark."""
    return f"cast(conv(substring(md5({text}), 1, 4), 16, 10) AS int)"


#: Entries of a list that changes: pattern, date and action from a host h and its number v.
_ENTRIES = (
    ("h", "v % 200", "'block'", "v % 3 = 0"),
    ("h", "v % 200 + 60", "'remove'", "v % 6 = 0"),
    ("h", "v % 200 + 90", "'block'", "v % 12 = 0"),
    ("h", "v % 300", "'allow'", "v % 5 = 1"),
    ("concat(h, '/en')", "v % 100", "'block'", "v % 7 = 3"),
    ("concat(h, '/en')", "v % 100 + 120", "'allow'", "v % 14 = 3"),
    ("substring(h, position('.' IN h) + 1, 1000)", "v % 30", "'block'", "v % 4 = 1"),
    ("substring(h, position('.' IN h) + 1, 1000)", "v % 30 + 30", "'remove'", "v % 2 = 1"),
)


def op10_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day of 2024 by their ids; the list has dated entries for their hosts."""
    pages = sh.table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id, 365) AS int))").alias("fetched"))
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h IS NOT NULL").distinct().withColumn("v", F.expr(_number("h")))
    kinds = ", ".join(f"struct({p} AS pattern, date_add(DATE'2024-01-01', {d}) AS since, {a} AS action, {w} AS holds)" for p, d, a, w in _ENTRIES)
    entries = hosts.select(F.explode(F.expr(f"array({kinds})")).alias("e")).where("e.holds").select("e.pattern", "e.since", "e.action")
    return url_filter.evaluated(pages, entries)


QUERIES = {f.__name__: f for f in (op1_threshold_topk, op2_exact_dedup, op3_vector_packing, op4_warc_index, op5_stratified_shards, op6_lsh_forest, op7_byte_bpe, op8_quality_trees, op9_license_scan, op10_temporal_url_list)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORACLE_ENTRIES = " UNION ALL ".join(f"SELECT {p} AS pattern, DATE '2024-01-01' + CAST({d} AS INTEGER) AS since, {a} AS action FROM hosts WHERE {w}" for p, d, a, w in _ENTRIES)

ORACLE_SQL = {
    "op1_threshold_topk": """
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM kept q JOIN kept c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 10""",
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)""",
    "op10_temporal_url_list": rf"""
        WITH captures AS (
            SELECT page_id, nullif(lower(regexp_extract(url, '{url_filter.HOST}', 1)), '') AS host, lower(coalesce(regexp_extract(url, '{url_filter.SEGMENT}', 1), '')) AS segment,
                   DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched
            FROM pages),
        hosts AS (SELECT DISTINCT host AS h, CAST(('0x' || substring(md5(host), 1, 4)) AS INTEGER) AS v FROM captures WHERE host IS NOT NULL),
        entries AS ({_ORACLE_ENTRIES}),
        ranked AS (SELECT pattern, since, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS rank FROM entries GROUP BY ALL),
        spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM ranked),
        -- The patterns that cover each host or URL, listed once a host.
        keys AS (SELECT DISTINCT host, segment, host || '/' || segment AS pattern, 1048576 AS depth FROM captures
                 UNION ALL
                 SELECT DISTINCT host, segment, array_to_string(string_split(host, '.')[i:], '.'), len(string_split(host, '.')) - i + 1
                 FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures)),
        active AS (SELECT c.page_id, s.pattern, s.since, s.rank, row_number() OVER (PARTITION BY c.page_id ORDER BY k.depth DESC) AS place
                   FROM captures c JOIN keys k USING (host, segment) JOIN spans s ON s.pattern = k.pattern
                   WHERE s.rank > 0 AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
        SELECT c.page_id, c.host, c.fetched, CASE a.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS action, a.pattern, a.since, coalesce(a.rank = 2, false) AS blocked
        FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.place = 1""",
}
