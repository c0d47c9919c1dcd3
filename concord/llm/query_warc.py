"""op5: the pages as WARC files, and an audit of a damaged replica."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.warc import audit_leaves, laid_out, leaves_of, response_record

#: Pages of one file.
PER_FILE = 500


def replica(pages: DataFrame) -> DataFrame:
    """The pages as records in files of PER_FILE numbers each: file, offset, record. Until the records are laid out, offset is twice the page's number."""
    return pages.select(F.floor(F.col("page_id") / PER_FILE).cast("string").alias("file"), (F.col("page_id") * 2).alias("offset"), response_record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica in which one byte of every 37th page is wrong, and every file has lost a record in its middle and holds one too many."""
    number = F.col("page_id")
    records = replica(pages.filter(F.coalesce(number % PER_FILE != 240, F.lit(True))))
    wrong = F.concat(F.lit(b"WARC/1.1"), F.substring("record", 9, 1 << 30))
    records = records.withColumn("record", F.when(F.col("offset") / 2 % 37 == 5, wrong).otherwise(F.col("record")))
    more = pages.filter(number % PER_FILE == 120)
    more = more.select(F.floor(number / PER_FILE).cast("string").alias("file"), (number * 2 + 1).alias("offset"), response_record(F.col("url"), F.concat(F.lit("more-"), number.cast("string")), F.lit("more")).alias("record"))
    return records.unionByName(more)


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit_leaves(laid_out(leaves_of(replica(pages)), "offset"), laid_out(leaves_of(damaged(pages)), "offset"))


QUERIES = {"op5_warc_fixity": op5_warc_fixity}
ORACLES = {
    "op5_warc_fixity": r"""
WITH parts AS (
  SELECT page_id, page_id // 500 AS f, page_id * 2 AS place, '<urn:page:' || page_id || '>' AS id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages
  UNION ALL SELECT NULL, page_id // 500, page_id * 2 + 1, '<urn:page:more-' || page_id || '>', coalesce(url, ''), 'more' FROM pages WHERE page_id % 500 = 120
), r AS (
  SELECT *, 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: ' || id || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS rest
  FROM parts
), expected AS (
  SELECT *, strlen(rest) + 10 AS length, coalesce(sum(strlen(rest) + 10) OVER (PARTITION BY f ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r WHERE page_id IS NOT NULL
), found AS (
  SELECT *, strlen(rest) + 10 AS length, coalesce(sum(strlen(rest) + 10) OVER (PARTITION BY f ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r WHERE page_id IS NULL OR page_id % 500 <> 240
), d AS (
  SELECT f, id, begins, length, rest, CASE WHEN page_id % 500 = 240 THEN 'missing' ELSE 'corrupt' END AS status FROM expected WHERE page_id % 500 = 240 OR page_id % 37 = 5
  UNION ALL SELECT f, id, begins, length, rest, 'extra' FROM found WHERE page_id IS NULL
)
SELECT f::VARCHAR AS file, id, begins::BIGINT AS "offset", length::BIGINT AS length, status,
  CASE WHEN status <> 'extra' THEN sha256('WARC/1.0' || chr(13) || chr(10) || rest) END AS digest_expected,
  CASE status WHEN 'corrupt' THEN sha256('WARC/1.1' || chr(13) || chr(10) || rest) WHEN 'extra' THEN sha256('WARC/1.0' || chr(13) || chr(10) || rest) END AS digest_found
FROM d"""
}
