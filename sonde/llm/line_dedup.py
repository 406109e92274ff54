"""Operator 5: boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_join, table

HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
BLOCK = "(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|br|tr|td|th|table|title|body|html|head|blockquote|pre)(?:\\s[^>]*)?/?>"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, with its port; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_lines(html: Column) -> Column:
    """Text of a page with one line for each block: scripts, styles and comments go, block tags end a line, other tags vanish."""
    x = F.regexp_replace(html, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(x, BLOCK, "\n"), "<[^>]*>", "")


def _lines(text: Column) -> Column:
    """Trimmed lines, with blanks of any length as one; blank lines are ''."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\f]+", " ")))


def boilerplate(pages: DataFrame, page_id: str, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """(host, line_hash): lines on more than ``ratio`` of a host's pages, on hosts of at least ``least_pages`` pages."""
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    each = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = pages.select(F.col(host).alias("host"), F.explode(each).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def drop_boilerplate(pages: DataFrame, page_id: str = "page_id", host: str = "host", text: str = "text", ratio: float = 0.3, least_pages: int = 5) -> DataFrame:
    """(page_id, host, text, n_lines, n_dropped) of every row: ``text`` without lines on more than ``ratio`` of the host's pages.

    Lines are compared trimmed, with runs of blanks as one; the kept ones are put out so, and blank lines go. A page counts
    once for a line, however often it has it; repeated rows count as pages of their own. Hosts of fewer than
    ``least_pages`` pages keep all their lines. A null host is the host ''. A null or empty text gives '' with no lines. Lines are
    counted by a 64-bit hash. At most mean lines per page / ``ratio`` lines of a host can be boilerplate, so they
    travel as one short list a host. Other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    bad = cut(boilerplate(rows, "page_id", "host", "text", ratio, least_pages).groupBy("host").agg(F.collect_set("line").alias("bad")))
    lines = F.filter(_lines(F.col("text")), lambda x: x != "")
    joined = small_join(rows, bad, ["host"], "left").withColumn("lines", lines)
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", F.xxhash64(x))))
    out = joined.withColumn("kept", kept)
    return out.select("page_id", "host", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return drop_boilerplate(pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text")))


_RE2_BLOCK = BLOCK.replace("(?i)", "").replace("\\s", "[ \\t\\n\\r\\f]")
OP5_SQL = f"""
WITH rows AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g'),
                        '{_RE2_BLOCK}', chr(10), 'gi'), '<[^>]*>', '', 'g') AS text FROM pages),
lines AS (
  SELECT page_id, host, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM rows),
totals AS (SELECT host, count(*) AS pages FROM rows GROUP BY host HAVING count(*) >= 5),
bad AS (
  SELECT host, list(line) AS bad FROM (
    SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lines) GROUP BY 1, 2) JOIN totals USING (host)
  WHERE n > 1 AND n > 0.3 * pages GROUP BY host),
kept AS (SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM lines LEFT JOIN bad USING (host))
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped FROM kept
"""
