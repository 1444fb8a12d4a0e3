"""Site-relative line frequency: lines that too many pages of one host share are boilerplate.

Per host, the pages that contain a line are divided by the pages of the host; a line above the ratio, on at
least MIN_PAGES pages, is dropped from every page of that host. A line is compared without spaces, tabs and
carriage returns around it; blank lines are neither counted nor dropped. Lines are counted by a 96-bit hash.

Per host at most (lines of an average page / ratio) lines can pass the ratio, so the array joined to a page
is bounded. It is written out first, so that the planner knows its size: a small one is broadcast, a large
one joined by host, where adaptive execution splits a host that holds many pages.

MIN_PAGES guards small hosts: on a host of fewer than 1 / RATIO pages every line would exceed the ratio.

Defined cases: a null host counts as the empty host; a null text has no lines and stays null; texts of any
length are used whole; repeated rows, of one doc_id or none, count each; a line at the ratio itself stays; an empty
table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, table

RATIO = 0.08
MIN_PAGES = 5
_AROUND = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_AROUND))
    return F.struct(F.xxhash64(bare).alias("k1"), F.hash(bare).alias("k2"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_AROUND)) == ""


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the keys of the lines to drop, for hosts that have any."""
    named = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _key))
    shared = (
        named.select("host", F.explode(keys).alias("line"))
        .groupBy("host", "line.k1", "line.k2")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    totals = named.groupBy("host").agg(F.count("*").alias("pages"))
    return (
        shared.join(totals, "host")
        .filter(F.col("n") > F.col("pages") * ratio)
        .groupBy("host")
        .agg(F.collect_list(F.struct("k1", "k2")).alias("lines"))
    )


def drop_lines(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with boilerplate lines taken out of `text`; other columns as they were."""
    at, lines = free_name(pages, "host_key"), free_name(pages, "boilerplate")
    drop = saved(boilerplate(pages, host, ratio, min_pages), "boilerplate").select(
        F.col("host").alias(at), F.col("lines").alias(lines)
    )
    kept = F.array_join(
        F.filter(_lines(F.col("text")), lambda x: _blank(x) | ~F.array_contains(F.col(lines), _key(x))), "\n"
    )
    joined = pages.withColumn(at, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(drop, at, "left")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).select(*pages.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_sha256 of every document, with its source as the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(_lines(F.col("text"))).alias("n"))
    return drop_lines(docs).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("n") > 1)), 0)
        .otherwise(F.size(_lines(F.col("text"))))
        .cast("long")
        .alias("n_kept"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP8_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents
), counted AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT DISTINCT r, host, trim(line, ' ' || chr(9) || chr(13)) AS line
        FROM (SELECT r, host, unnest(lines) AS line FROM cut))
  WHERE line <> '' GROUP BY host, line
), totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
boiler AS (
  SELECT host, list(line) AS lines FROM counted JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE) GROUP BY host
), kept AS (
  SELECT doc_id, cut.lines AS lines, text,
    CASE WHEN boiler.lines IS NULL THEN cut.lines
         ELSE list_filter(cut.lines, lambda x: NOT list_contains(boiler.lines, trim(x, ' ' || chr(9) || chr(13)))) END AS left_lines
  FROM cut LEFT JOIN boiler USING (host)
), joined AS (SELECT *, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(left_lines, chr(10)) END AS kept_text FROM kept)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN kept_text IS NULL OR (kept_text = '' AND len(lines) > 1) THEN 0
       ELSE len(string_split(kept_text, chr(10))) END AS BIGINT) AS n_kept,
  sha256(kept_text) AS kept_sha256
FROM joined
"""
